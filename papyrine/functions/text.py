"""Text keys and normalisers as column expressions (all stay in the JVM).

Every function takes and returns a column.  Nulls stay null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals that stand for a missing value (fixed values).
NULL_LITERALS = ("null", "nil", "nan", "na", "unknown", "unspecified", "not specified", "not applicable", "-", "--")
# Labels too general to be a topic (fixed values).
GENERIC_LABELS = (
    "machine learning", "deep learning", "artificial intelligence", "ai", "optimization", "classification", "regression", "prediction",
    "generation", "representation learning", "supervised learning", "unsupervised learning", "computer vision",
    "natural language processing", "nlp", "general", "none", "n/a", "other", "everything else", "various", "multiple",
)
# Source URL patterns of the tracks, in order (fixed values).
TRACK_RULES = (
    (r"(?i)/\d{4}/Conference", "main"),
    (r"(?i)Position_Paper_Track", "position"),
    (r"(?i)^TMLR", "tmlr-journal"),
    (r"(?i)JmlrOrg", "jmlr-journal"),
    (r"(?i)ANN-STATS", "annals-stats"),
)
# A count or a category in place of a name (fixed values).
PLACEHOLDER = (
    r"^(a|an|the)?\s*(\d+|two|three|four|five|six|several|multiple|various|many|numerous|all|some|other|another|standard|common|public|open|"
    r"open-source|large[- ]scale|diverse|real[- ]world|real|synthetic|simulated|benchmark|in[- ]domain|out[- ]of[- ]domain|downstream|"
    r"widely[- ]used|popular|different)?\s*(datasets?|benchmarks?|data|corpora|corpus|tasks?|environments?|settings?)$"
)
PLACEHOLDER_TAIL = r"\b(benchmarks|datasets|corpora|suites|environments|tasks)$"
# Words left out of title tokens (fixed values).
TITLE_STOP = ("the", "and", "for", "with", "via", "from", "into", "using", "based")
# Words left out of the search index (fixed values).
SEARCH_STOP = tuple(
    "the of and to in a for we is are that with on this by as an be our it can from which at or not but have has been more most their its "
    "using use used show shows shown propose proposed present presents new novel results result method methods approach model models "
    "learning data paper work also than such these those when where while however thus each other both between into over under only very "
    "much many any all some one two three does do done make makes made may might will would could should because since if then so no nor "
    "own same too here there about after before during through against you your".split()
)
# Words of the search list that count in a stated failure (fixed values).
_FAILURE_WORDS = frozenset("not our show shown present presents novel paper any all some three done made might nor too here after before during through you your".split())
# Further words that name no failure (fixed values).
FAILURE_STOP = tuple(w for w in SEARCH_STOP if len(w) > 2 and w not in _FAILURE_WORDS) + tuple(
    "existing current prior previous conventional traditional approaches works often typically remain remains limited limitation limitations "
    "challenge challenges challenging difficult difficulty problem problems issue issues significant significantly large high low widely various "
    "based rely relies require requires requiring expensive costly cost costs lack lacks fail fails failure unable cannot still them without "
    "performance tasks task training either struggle struggles suffer suffers making due was were they what who how why less others well even "
    "across within although though hence therefore moreover furthermore despite unlike among along usually generally highly particularly "
    "especially several including include includes leading leads lead given uses via per yet way ways key main real world recent recently "
    "different single multiple specific important common poor poorly hard hinder hinders hindering prevent prevents prevented ignore ignores "
    "ignoring overlook overlooks neglect neglects capture captures capturing achieve achieves achieving obtain handle handling address addresses "
    "addressing focus focuses focusing focused consider considers resulting solutions solution".split()
)

_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžčćđłńřśťůőű", "aaaaaaceeeeiiiinoooooouuuuyyszccdlnrstuou")


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to one blank: the key of matching and citing."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def dedupe_key(c: Column) -> Column:
    """Letters, digits and underscores of any script, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def plain(c: Column) -> Column:
    """Letters and digits with common accents folded."""
    return F.regexp_replace(F.translate(F.lower(c), *_ACCENTS), "[^a-z0-9]+", "")


def basic(c: Column) -> Column:
    """Lower case without trailing punctuation; dashes, slashes and underscores are blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s.,;:]+$", ""), r"[\s\-_/]+", " "))


def singular(c: Column) -> Column:
    """A final s dropped, but not of -ics, -ss, -us, -is, -as, nor from short words."""
    return F.when((F.length(c) > 3) & ~c.rlike("(ics|ss|us|is|as)$"), F.regexp_replace(c, "(?<=[a-z])s$", "")).otherwise(c)


def canon(c: Column) -> Column:
    """A label's key: :func:`basic` without task and problem words, cautiously singular."""
    return singular(F.trim(F.regexp_replace(F.regexp_replace(basic(c), r"\b(tasks?|problems?|applications?)\b", ""), r"\s+", " ")))


def dataset_key(c: Column) -> Column:
    """One key for the spellings of a dataset; a plus sign is part of the name."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"^(the|a)\s+", ""), r"\s+(benchmark|dataset|corpus|suite)s?$", "")
    return F.regexp_replace(bare, "[^a-z0-9+]", "")


def is_placeholder(c: Column) -> Column:
    """Whether a name is a count or a category ('three datasets', 'image datasets')."""
    b = basic(c)
    return b.rlike(PLACEHOLDER) | b.rlike(PLACEHOLDER_TAIL)


def is_label(c: Column) -> Column:
    """Whether a canonical string may be a topic."""
    return (F.length(c) >= 4) & ~c.isin(*GENERIC_LABELS) & ~c.isin(*NULL_LITERALS)


def fold_dashes(c: Column) -> Column:
    return F.regexp_replace(c, "[‐-―−]|--+", "-")


_GLOSS = r"\(([A-Za-z][A-Za-z0-9\-/]{1,17})\)"


def method_key(c: Column) -> Column:
    """struct(key, acronym): a gloss '(ACR)' anywhere is taken off and becomes the acronym.

    A placeholder has an empty key; a name that is nothing but a gloss is that name.
    """
    n = F.trim(fold_dashes(c))
    gloss = F.regexp_extract(n, _GLOSS, 1)
    rest = squeeze(F.regexp_replace(n, r"\s*" + _GLOSS + r"\s*", " "))
    name = F.when(gloss == "", n).when(rest == "", gloss).otherwise(rest)
    key = F.when(is_placeholder(n), F.lit("")).otherwise(singular(basic(name)))
    acronym = F.when((gloss != "") & (rest != "") & (key != ""), singular(basic(gloss)))
    return F.struct(key.alias("key"), acronym.alias("acronym"))


def title_tokens(c: Column, stop: Sequence[str] = TITLE_STOP) -> Column:
    """Distinct tokens of three or more letters without stop words, in order."""
    return F.array_distinct(F.filter(F.split(norm(c), " "), lambda t: (F.length(t) > 2) & ~t.isin(*stop)))


def words(c: Column) -> Column:
    """Index words in order: a letter, then two or more letters, digits or dashes; stop words kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9\-]{2,})"), F.lit(1))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs, joined by a blank."""
    return F.filter(F.zip_with(tokens, _shifted(tokens), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))), lambda p: p.isNotNull())


def _shifted(tokens: Column) -> Column:
    """The array without its first element; zipped with the array it gives neighbours without an index."""
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))


def failure_terms(c: Column, label: str = "") -> Column:
    """Distinct words of five letters or more and pairs of a stated failure.

    Pairs are formed after stop words, and the words of the topic's own ``label``, are taken out.
    """
    import re

    own = re.findall(r"[a-z][a-z\-]{2,}", label.lower())
    w = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z\-]{2,})"), F.lit(1)), lambda t: ~t.isin(*FAILURE_STOP, *own))
    return F.array_distinct(F.concat(F.filter(w, lambda t: F.length(t) >= 5), bigrams(w)))


def index_terms(c: Column, stop: Sequence[str] = SEARCH_STOP) -> Column:
    """Distinct unigrams, and bigrams formed before stop words are removed."""
    w = F.transform(words(c), lambda t: F.struct(t.alias("t"), t.isin(*stop).alias("stop")))
    keep = F.transform(F.filter(w, lambda x: ~x["stop"]), lambda x: x["t"])
    pairs = F.zip_with(w, _shifted(w), lambda a, b: F.when(~a["stop"] & ~b["stop"], F.concat_ws(" ", a["t"], b["t"])))
    return F.array_distinct(F.concat(keep, F.filter(pairs, lambda p: p.isNotNull())))


def classify(c: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that occurs; null and no match give ``other``."""
    out = None
    for pattern, label in rules:
        hit = F.coalesce(c.rlike(pattern), F.lit(False))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other) if out is not None else F.lit(other)


def split_topic(c: Column) -> Column:
    """struct(area, subarea) of 'area->subarea'; empty parts are skipped."""
    parts = F.filter(F.transform(F.split(c, "->"), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("area"), F.try_element_at(parts, F.lit(2)).alias("subarea"))


def submission_id(url: Column) -> Column:
    """The id parameter of a URL, null where there is none."""
    return F.nullif(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]+)", 1), F.lit(""))


def institution(c: Column) -> Column:
    """White space, company forms and a repeated 'X, X' taken off; null where nothing is left."""
    s = F.regexp_replace(F.trim(squeeze(c), F.lit(", ")), r"(?i)\s*,?\s*(inc\.?|ltd\.?|llc)\s*$", "")
    parts = F.filter(F.transform(F.split(s, ","), lambda p: F.trim(p)), lambda p: p != "")
    one = (F.size(parts) > 1) & (F.size(F.array_distinct(F.transform(parts, lambda p: F.lower(p)))) == 1)
    return F.nullif(F.when(one, F.element_at(parts, 1)).otherwise(s), F.lit(""))


def clean_url(c: Column) -> Column:
    """Trailing punctuation taken off."""
    return F.regexp_replace(c, r"[.,;:!?)\]}>'\"]+$", "")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def bibtex_escape(c: Column) -> Column:
    """Backslash first, then the signs that BibTeX reads."""
    c = F.replace(c, F.lit("\\"), F.lit("\\textbackslash "))
    for sign in "&%$#_{}":
        c = F.replace(c, F.lit(sign), F.lit("\\" + sign))
    return c


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 where one is empty."""
    less = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(less > 0, F.size(F.array_intersect(a, b)) / less).otherwise(F.lit(0.0))


def mark(c: Column, term: str, left: str = "<i>", right: str = "</i>") -> Column:
    """Every occurrence of a term, in any case, put between two signs."""
    import re

    return F.regexp_replace(c, "(?i)(" + re.escape(term) + ")", left + "$1" + right)


def contains_term(c: Column, term: Column) -> Column:
    """Whether the words of ``term`` stand in ``c`` as whole words; both are normalised."""
    return F.contains(F.concat(F.lit(" "), norm(c), F.lit(" ")), F.concat(F.lit(" "), norm(term), F.lit(" ")))
