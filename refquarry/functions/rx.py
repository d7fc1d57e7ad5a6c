"""Regular expressions of the reference-mining domain, in the subset that Java and RE2 share."""

# The patterns that decide what counts as numeric information, a DOI, a URL or a study name.
PERCENT = r"\d+[.,]?\d*\s*%"
ENUM = r"([,;/&\\]|and|und)"
RANGE = r"(-|–|bis|to|till|until)"
YEAR = r"\d{4}"
ABBREVIATED_YEAR = r"'\d\d"
NUMBER = r"\d+[.,]?\d*"
NUM = r"'?\d+[.,]?\d*"
PUNCTUATION = r"[.,;!?]"
COMPLEX_NUMERIC = rf"{NUM}(?:\s*(?:[,;/&\\]|and|und|-|–|bis|to|till|until)\s*{NUM})?"
DOI = r"10\.\d+?/\S+[^[:punct:]]"
DOI_JAVA = r"10\.\d+?/\S+\P{Punct}"
URL = r"\b(?:https?|ftp|file)://[-a-zA-Z0-9+&@#/%?=~_|!:,.;]*[-a-zA-Z0-9+&@#/%=~_|]|www\d?\..*?\.[^\d\s]+"
#: what stands before a match on its line, and after it
LEFT_CONTEXT, RIGHT_CONTEXT = r"([^\n]*?)", r"([^\n]*)"
#: any run without white space, one in the middle of a context, and one at its end
WORD, ATOMIC_WORD, LAST_WORD = r"\S+", r"\S+\s", r"\S+$"
STUDY_NGRAM = r"\S*?\s?\S+?\s?\S+?\s?\S+?\s?\S*?"
PUNCT_RUN_JAVA = r"\p{Punct}+"
PUNCT_RUN_RE2 = r"[[:punct:]]+"
DIGIT_RATIO = r"\d+"
DECIMAL = r"\d+\.\d+"
LINK_ITEM = r'<li><a href="([^"]*)">([^<]*)'
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]|\p{Cf}|\p{Co}"
#: handwritten reference patterns: group 1 is the term
HANDWRITTEN = {
    "first_before_of": r"^(\S+) of\b",
    "first_before_the": r"^(\S+) the\b",
    "first_before_de": r"^(\S+) de\b",
    "sentence_before_the": r"[.] (\S+) the\b",
    "sentence_before_of": r"[.] (\S+) of\b",
}
