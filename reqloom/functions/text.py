"""Text functions, Column -> Column; all but ``unescape_html`` and ``demojize`` stay in the JVM."""

from __future__ import annotations

import html
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from reqloom.functions.plan import let

#: White space as Unicode has it, with the separators 0x1c-0x1f.
SPACE = r"(?U)[\s\x1c-\x1f]+"

# Product categories in order, the first pattern found in the lower-cased title wins.
CATEGORY_PATTERNS: tuple[tuple[str, str], ...] = (
    ("tablet", r"\bipad\b|tablet|galaxy tab|surface pro\b|surface go\b|surface \d+\b|transformer(?: pad)?"),
    ("console", r"playstation|\bps[45]\b|xbox|nintendo switch|\bswitch\b|steam deck|rog ally|legion go|stadia"),
    ("vr", r"vision pro|meta quest|\bquest\b|\bvr\b|smart glasses|ray-?ban meta"),
    ("watch", r"\bwatch\b|\bband\b|fitbit|garmin|galaxy gear|galaxy ring|smartwatch|moto ?360"),
    ("headphone", r"headphone|earbud|airpods|\bbuds\b|headset|\bbeats\b|wh-?1000|\bxm[345]\b|beyerdynamic|audio technica|ath-m\d+|sony mdr"),
    ("monitor", r"\bmonitor\b|studio display|lg ultrafine|\bdisplay\b"),
    ("tv", r"\btv\b|\bqled\b|\boled tv\b|\bs95[cd]\b"),
    ("desktop", r"mac studio|mac mini|\bimac\b|mac pro\b|desktop|\bpc build|\bgaming pc\b|alienware aurora|\bnuc\b|corsair one"),
    ("camera", r"\bcamera\b|gopro|\bdji\b|drone|\brx\d+\b|sony nex|\bcanon\b|webcam"),
    (
        "phone",
        r"iphone|galaxy s\d|galaxy z|galaxy note|galaxy a\d|galaxy alpha|galaxy mega|\bpixel\b|oneplus|"
        r"\bphone\b|nothing phone|xiaomi|huawei|\bmoto\b|nexus|\bfold\b|\bflip\b|smartphone|"
        r"lumia|\boppo\b|\bhtc\b|\bnokia\b|\blg g\d\b|\blg optimus\b|\bmi \d|galaxy (?!book)|red hydrogen|motorola|droid|blackberry|surface duo|nextbit|pocophone|\bpoco\b|redmi|xperia|zenfone|one plus|realme|honor magic|\brazer\b|jovi|vivo",
    ),
    (
        "laptop",
        r"laptop|notebook|macbook|\byoga\b|thinkpad|zenbook|vivobook|\bxps\b|surface laptop|surface book|"
        r"chromebook|\brog\b|legion|razer blade|\bomen\b|\baero\b|\bg1[456]\b|spectre|\benvy\b|"
        r"inspiron|latitude|\bswift\b|aspire|predator|pavilion|\bdell\b|\bhp\b|\bacer\b|\bmsi\b|"
        r"gigabyte|framework|matebook|ideapad|\bslim\b|alienware|galaxy book|\bgram\b|\btuf\b|"
        r"strix|zephyrus|\by\d{3}\b|\bx1 carbon\b|\bgl\d{3}\b|\bux\d{3}\b|\bg\d{3}\b|ultrabook|"
        r"triton|\bblade\b|\bstealth\b|\bx\d{2}\b|snapdragon x|\bmac\b|\blenovo\b|\basus\b|proart|aorus|eluktronics|helios|hasee|venom|pixelbook",
    ),
)
# Fixed value: titles that announce a review.
REVIEW_PATTERN = r"\breview\b|\brant\b|\bhands[- ]on\b|\bunboxing\b|\bimpressions\b"
# The frozen cues of requests and complaints.
LEXICON: Mapping[str, Sequence[str]] = {
    "pedido": (r"\bi wish\b", r"\bshould(?: have|'ve)\b", r"\bhoping for\b", r"\bwould have liked\b", r"\bmissing\b", r"\bi would like\b"),
    "queixa": (
        r"\bdisappoint\w*\b", r"\bi (?:do not|don't) like\b", r"\bissue\b", r"\bproblem\b", r"\bcomplain\w*\b",
        r"\bannoy\w*\b", r"\black\b", r"\bdownside\b", r"\bdrawback\b", r"\bunfortunately\b",
    ),
}
# Words that mark Portuguese text.
PORTUGUESE = ("não", "você", "muito", "também")
# Aspects an annotator may name.
ASPECTS = ("bateria", "termico", "tela", "portas", "teclado", "audio", "camera", "preco", "construcao", "desempenho", "outro")
# Stop words of the video domain.
EXTRA_STOP_WORDS = ("yeah", "okay", "gonna", "wanna", "gotta", "kind", "lot", "thing", "stuff", "guy", "video", "channel", "subscribe", "like")
#: English function words; a parameter wherever it is used.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can "
    "could did do does doing down during each even few for from further get got had has have having he her here hers him his "
    "how i if in into is it its just me more most my no nor not now of off on once one only or other our out over own same she "
    "should so some such than that the their them then there these they this those through to too under until up us very was we "
    "were what when where which while who whom why will with would you your".split()
)
#: Function words that vote for a text's language, in the order that breaks ties.
LANGUAGE_WORDS: Mapping[str, Sequence[str]] = {
    "en": "the and of to in is that for it with as was on are be by this from at an".split(),
    "fr": "le la les des et en un une du que dans pour est qui sur pas au par ne se".split(),
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es".split(),
    "es": "el los las del y que en un una por con para su al lo como más pero sus se".split(),
    "pt": "o os uma não você muito também com para por mais como mas dos das na no ao ele ela".split(),
}


def collapse_runs(text: Column) -> Column:
    """Three or more of one character (line feeds aside) become two."""
    return F.regexp_replace(text, r"(?d)(.)\1{2,}", "$1$1")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def unescape_html(text: Column) -> Column:
    """HTML5 entities resolved. Spark has no such function; texts with ``&`` go through Arrow, others as nulls."""
    has = text.contains("&")
    resolved = F.pandas_udf(lambda x: x.map(html.unescape, na_action="ignore"), "string")(F.when(has, text))
    return F.when(has, resolved).otherwise(text)


def demojize(text: Column, names: Callable[[pd.Series], pd.Series]) -> Column:
    """Emoji replaced by what ``names`` (a batch function) makes of them."""
    return F.pandas_udf(names, "string")(text)


def clean_text(text: Column, unescape: bool = True, emoji: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """Entities, emoji, runs of one character, white space; in that order."""
    if unescape:
        text = unescape_html(text)
    if emoji is not None:
        text = demojize(text, emoji)
    return collapse_space(collapse_runs(text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))


def product_category(title: Column) -> Column:
    """The first category whose pattern the title has; ``other`` if none (and for null)."""
    lowered = F.lower(F.coalesce(title, F.lit("")))
    out = F
    for category, pattern in CATEGORY_PATTERNS:
        out = out.when(lowered.rlike(f"(?U){pattern}"), F.lit(category))
    return out.otherwise(F.lit("other"))


def title_has_review(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(f"(?i){REVIEW_PATTERN}")


def iso_date(compact: Column) -> Column:
    """YYYYMMDD -> YYYY-MM-DD; null unless there are 8 characters."""
    text = compact.cast("string")
    return F.when(F.length(text) == 8, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))


def iso_year(iso: Column) -> Column:
    return F.substring(iso, 1, 4).try_cast("int")


def video_id(url: Column) -> Column:
    """The id in a youtu.be or youtube.com url (v=, /shorts/, /embed/, /live/); else null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), r":\d*$", "")
    path = F.regexp_extract(url, r"^[^?#]*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    short = F.split(F.regexp_replace(path, "^/+", ""), "/")[0]
    named = F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1)
    placed = F.regexp_extract(path, r"^/(?:shorts|embed|live)/([^/]+)", 1)
    found = F.when(host == "youtu.be", short).when(host.endswith("youtube.com"), F.when(named != "", named).otherwise(placed))
    return F.nullif(found, F.lit(""))


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case words of two or more letters a-z; ``stop_words`` left out afterwards."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-zA-Z]{2,}\b"), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda w: ~w.isin(list(stop_words)))


def detect_language(text: Column, least_words: int = 5) -> Column:
    """The language most of whose function words occur; null below ``least_words`` words or without any."""
    names = F.array(*map(F.lit, LANGUAGE_WORDS))
    every = sorted({w for own in LANGUAGE_WORDS.values() for w in own})
    # an array's first largest number decides, so languages come first in their order
    pick = lambda votes: F.when(F.array_max(votes) > 0, F.element_at(names, F.array_position(votes, F.array_max(votes)).cast("int")))
    count = lambda known: F.array(*(_hits(known, list(own)) for own in LANGUAGE_WORDS.values()))
    vote = lambda words: let(let(F.filter(words, lambda w: w.isin(every)), count), pick)
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    return let(words, lambda held: F.when(F.size(held) >= least_words, vote(held)))


def _hits(words: Column, own: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(own)))


def lexicon_counts(text: Column, lexicon: Mapping[str, Sequence[str]] = LEXICON) -> dict[str, Column]:
    """For each kind, how many of its patterns (not: how often) occur."""
    filled = F.coalesce(text, F.lit(""))
    return {kind: sum((filled.rlike(f"(?iU){p}").cast("int") for p in patterns), F.lit(0)) for kind, patterns in lexicon.items()}


def lexicon_hint(counts: Mapping[str, Column], otherwise: str = "outro") -> Column:
    """The first kind with a hit."""
    out = F
    for kind, n in counts.items():
        out = out.when(n > 0, F.lit(kind))
    return out.otherwise(F.lit(otherwise))


def portuguese_words(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(rf"(?U)\b(?:{'|'.join(PORTUGUESE)})\b"))


def aspects(text: Column) -> Column:
    """A comma-separated list as an array of the known aspects in it."""
    named = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.filter(named, lambda x: x.isin(list(ASPECTS)))


def sentences(cleaned: Column) -> Column:
    """Sentences of a cleaned text (single spaces): a stop, an exclamation or a question mark ends one before a space."""
    marked = F.split(F.regexp_replace(cleaned, r"([.!?]) ", "$1\n"), "\n")
    return F.filter(F.transform(marked, lambda s: F.trim(s)), lambda s: s != "")
