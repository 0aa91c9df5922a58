"""Word lists and constants that results depend on.  Every operator takes them as parameters."""

from __future__ import annotations

# Weights of the searched columns, and constants of BM25.
FIELD_WEIGHTS = {"title": 16.0, "subtitle": 8.0, "headings": 8.0, "summary": 4.0, "full_text_plain": 1.0, "contributors": 2.0}
BM25_K1, BM25_B, LEAST_IDF = 1.2, 0.75, 1e-6

# Fusion of the lexical and the semantic ranking.
LEXICAL_WEIGHT, SEMANTIC_WEIGHT, RRF_K = 1.0, 0.55, 40.0
EXACT_ISSUE, PHRASE_TITLE, PHRASE_HEADING, PHRASE_BODY = 10.0, 6.0, 4.0, 3.0
TITLE_OVERLAP, TOPIC_MATCH, AGREEMENT, MULTI_CHUNK = 1.5, 1.5, 1.25, 0.75
SEMANTIC_ONLY_PENALTY, STRONG_LEXICAL = -3.5, 3
SEMANTIC_FLOOR, CHUNK_FLOOR, SEMANTIC_TOP = 0.75, 0.72, 15
SNIPPET_LONG, SNIPPET_SHORT, SNIPPET_TOP = 400, 150, 3

# Operators and sections of the query language.
OPERATORS = ("before", "after", "year", "issue", "section", "topic")
SECTIONS = ("lead_essay", "signposts", "worth_your_time", "lens", "book", "postcard", "more_from", "other")
SECTION_TITLES = {
    "signposts": r"signpost",
    "worth_your_time": r"worth\s+your\s+time",
    "lens": r"lens\s+of\s+the\s+week",
    "book": r"book\s+(for|of)\s+your",
    "postcard": r"postcard\s+from\s+the\s+future",
    "more_from": r"^\W*more\s+from\s",
}

# Lengths of chunks in characters.
CHUNK_LEAST, CHUNK_MOST, CHUNK_OVERLAP = 1200, 3200, 200

# Words that may not begin or end a phrase of the lexicon.
PHRASE_STOPWORDS = tuple(
    "the a an and or but if so as at be by for in is it of on to with this that these those are was were have has had will "
    "would should could can may might do does did not no yes about into from up down out all any some many much more most "
    "than then when where why how what who whom i you we they he she them us me his her their our my your its".split()
)
# Further words left out of the contexts of a term.
DRIFT_STOPWORDS = (*PHRASE_STOPWORDS, "one", "two", "s", "re", "ve", "d", "m", "ll")
# Words without content in a keyword.
KEYWORD_STOPWORDS = tuple("a an the and or but of for to in on with by from as at is are was were be been being".split())
LEAST_PMI, LEAST_COOCCURRENCE, LEXICON_SIZE = 3.0, 5, 500

# Word lists of the quality rules.
PROTECTED = ("ai", "llm", "gpt", "crypto", "defi", "nft", "dao", "react", "rust", "github", "twitter", "wikipedia")
NOISE_WORDS = tuple(
    "leverage enable utilise utilize enabling enabled making doing getting using taking putting looking thinking wanting "
    "needing going better worse harder easier faster slower simpler complex simple complicated big small large huge tiny "
    "long short old new good bad system systems data thing things stuff piece parts part kind sort type way ways time times "
    "place places case cases move moves point points direction directions life work idea ideas story stories problem problems "
    "someone everyone anyone something everything anything really actually basically literally obviously clearly simply "
    "mostly usually always never software platform product team people world space area industry".split()
)
PRONOUN_LEADS = tuple("someone everyone anyone something everything anything this that these those their them".split())
MARKUP_TOKENS = tuple("img src href alt nbsp http https jpg jpeg png gif webp iframe script style class".split())
MARKUP_PHRASES = ("img src", "src href", "href img", "alt text", "highlighting independent publications")
MALFORMED_PHRASES = (
    "secretary of defense rock", "exchange commission", "many americans", "top-right quadrant", "labor day", "golden state", "world war",
    "le guin", "packy mc", "native american", "technology review", "census bureau", "air force", "biggest film bombed",
)
MALFORMED_TOKENS = tuple("you your can could should would will may might must".split())
MALFORMED_STARTS = tuple("as because while when where why how".split())
WEAK_ENDS = tuple("like from with without into onto about toward towards".split())
WEAK_SUFFIX = r"(ly|ize|ise|ify|ment|oes|ays|akes|ives)$"
BOILERPLATE = ("editor note", "editors note", "editor s note", "worth your time", "lens of the week", "book for your shelf", "postcard from the future")
SENTENCE_LEADS = tuple(
    "But And However Yet Or So For Nor Although Because If While When Then Now This That These Those The A An It We They He "
    "She His Her Our Their My Your".split()
)

# What the ways of finding topics are worth.
SOURCE_PRIORITY = {"known_entity": 4, "phrase_lexicon": 3, "heuristic_entity": 2, "yake": 1}
SOURCE_SCORE = {"known_entity": 0.05, "phrase_lexicon": 0.06, "heuristic_entity": 0.08}
COMMONNESS = 4.75
#: Phrases up to which a lexicon is broadcast: some hundred kilobytes.
SMALL_LEXICON = 10_000
