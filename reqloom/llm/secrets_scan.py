"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 20 or more key-like characters in a word, or, right after
a key word and an assignment (``password = ...``), a value of 8 or more characters
of any kind but white space, quotes, brackets, commas and semicolons. Its features
are its length, its transitions between character classes, how much of it a
dictionary covers, and what its path and its neighbouring words say. The forest
is trained from labelled findings (``labelled_findings`` makes a set of them by
rule; pass your own in their place). Candidates are found and scored where the
text lies: there is no shuffle, and nothing but DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import table, written

LEAST = 20
CLASS = "A-Za-z0-9+/_=-"
CANDIDATE = f"(?<![{CLASS}])[{CLASS}]{{{LEAST},}}"
NEIGHBOURS = 3
#: Characters of a shorter candidate, of what a key word's name goes on with, and of the text before a word that the two can reach.
SHORT_LEAST, NAME_MOST, AHEAD = 8, 40, 100
TREES, DEPTH, SEED = 24, 8, 7
#: Labelled findings that the generator makes.
FINDINGS = 4000

#: Words of the dictionary whose share in a candidate tells prose and identifiers from random keys.
DICTIONARY = (
    "about after again also back because been before between both came come could data date day each even file find first "
    "from get give good great hand have header here high home image index into just know last life line list long look made "
    "make many message more most much must name never next number only other over page part people place point right same "
    "should since some state still such system take tell than that the their them then there these they thing think this "
    "time tion ment used user value very want was way well went were what when where which while will with without word work "
    "world would year your ing and for not are all her his has had out one who der die und das ein nicht les des que pour "
    "dans los las una por con para"
).split()
_PAIRS = "th he in er an re nd on en at ou ed ha to or it is hi es ng".split()

_KEY_NAMES = r"token|secret|passw|pwd|api.?key|apikey|auth|bearer|credential|private|access.?key|client.?key|\bkey\b"
_KEY_WORDS = f"(?i)({_KEY_NAMES})"
#: A key word's assignment and the value's first characters; in a word with those before it, the whole value up to the word's end.
_ASSIGNED = f"(?i)(?:{_KEY_NAMES})[A-Za-z0-9_.-]{{0,{NAME_MOST}}}[\"'`\\]]{{0,3}}\\s?(?::=|=>|=|:)\\s?[\"'`]?"
_VALUE = f"[^\\s\"'`,;<>()\\[\\]{{}}]{{{SHORT_LEAST},"
SHORT_ANYWHERE = f"(?i)(?:{_KEY_NAMES})[A-Za-z0-9_.-]{{0,{NAME_MOST}}}[\"'`\\]]{{0,3}}\\s*(?::=|=>|=|:)"
SHORT = f"{_ASSIGNED}({_VALUE}}}+)\\S*+\\z"
_HASH_WORDS = r"(?i)(commit|sha1|sha256|sha-|md5|checksum|digest|revision|integrity|etag|hash|uuid|guid|base64)"
_SAMPLE_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|redacted|fake|test)"

FEATURES = (
    "length", "digits", "uppers", "lower_digit", "lower_upper", "upper_digit", "others", "vowels", "common_pairs", "consonant_runs",
    "distinct", "hexadecimal", "all_digits", "covered", "slashes", "dashes", "prefixed", "sample_like", "key_before", "hash_before",
    "sample_near", "assigned", "quoted", "url", "path_test", "path_lock", "path_config",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def featured(findings: DataFrame) -> DataFrame:
    """Adds the columns FEATURES to (candidate, word, before, after, path); nulls count as empty."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("candidate", "word", "before", "after", "path")}
    c, n = text["candidate"], F.greatest(F.length(text["candidate"]), F.lit(1)).cast("double")
    near = F.concat_ws(" ", text["before"], text["word"], text["after"])
    ahead = F.concat_ws(" ", text["before"], text["word"])
    path = F.lower(text["path"])
    uncovered = F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    flag = lambda x: x.cast("double")
    values = {
        "length": n,
        "digits": _count(c, "[0-9]") / n,
        "uppers": _count(c, "[A-Z]") / n,
        "lower_digit": (_count(c, "[a-z](?=[0-9])") + _count(c, "[0-9](?=[a-z])")) / n,
        "lower_upper": (_count(c, "[a-z](?=[A-Z])") + _count(c, "[A-Z](?=[a-z])")) / n,
        "upper_digit": (_count(c, "[A-Z](?=[0-9])") + _count(c, "[0-9](?=[A-Z])")) / n,
        "others": _count(c, "[^A-Za-z0-9]") / n,
        "vowels": _count(c, "[aeiouAEIOU]") / n,
        "common_pairs": _count(F.lower(c), f"(?=({'|'.join(_PAIRS)}))") / n,
        "consonant_runs": _count(F.lower(c), "[bcdfghjklmnpqrstvwxz]{4,}") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "hexadecimal": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "all_digits": flag(c.rlike("^[0-9_+=/-]+$")),
        "covered": 1 - uncovered / n,
        "slashes": _count(c, "/") / n,
        "dashes": _count(c, "[_-]") / n,
        "prefixed": flag(c.rlike("^(AKIA|ASIA|gh[pousr]_|sk_|pk_|rk_|xox[bap]-|glpat-|eyJ|AIza)")),
        "sample_like": flag(c.rlike("(?i)(example|sample|placeholder|changeme|x{6}|0{8}|1234567|abcdef012)")),
        "key_before": flag(ahead.rlike(_KEY_WORDS)),
        "hash_before": flag(ahead.rlike(_HASH_WORDS)),
        "sample_near": flag(near.rlike(_SAMPLE_WORDS)),
        "assigned": flag(F.concat(text["before"], text["word"]).rlike("[=:][\"' ]*")),
        "quoted": flag(text["word"].rlike("[\"'`]")),
        "url": flag(text["word"].rlike("(://|www\\.|\\.(com|org|net|html?|png|jpg|js|css)\\b)")),
        "path_test": flag(path.rlike("test|spec|fixture|example|sample|mock|doc")),
        "path_lock": flag(path.rlike("lock|sum$|\\.map$|\\.min\\.|vendor|dist")),
        "path_config": flag(path.rlike("\\.(env|ya?ml|json|ini|cfg|conf|properties|toml)$|config|settings")),
    }
    return findings.withColumns(values)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, word_index, nth, candidate, word, before, after, path) of every candidate in the whole texts.

    A word's long candidates come first, then its shorter one, if it has one.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    assigning = F.col("text").contains("=") | F.col("text").contains(":")
    rows = rows.where(F.col("text").rlike(CANDIDATE) | (assigning & F.col("text").rlike(SHORT_ANYWHERE)))
    rows = rows.select("doc_id", "path", F.explode(F.array(F.split("text", r"\s+"))).alias("w"))
    ahead = lambda i: F.right(F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)), F.lit(AHEAD))
    short = lambda i, w: F.regexp_extract(F.concat(ahead(i), F.lit(" "), w), SHORT, 1)
    placed = F.transform("w", lambda w, i: F.struct(i.alias("i"), w.alias("word"), short(i, w).alias("short")))
    marked = F.filter(placed, lambda x: (x["short"] != "") | x["word"].rlike(CANDIDATE))
    around = F.transform(
        marked,
        lambda x: F.struct(
            x["i"].alias("i"),
            x["word"].alias("word"),
            x["short"].alias("short"),
            F.array_join(F.slice(F.col("w"), F.greatest(x["i"] + 1 - NEIGHBOURS, F.lit(1)), F.least(x["i"], F.lit(NEIGHBOURS))), " ").alias("before"),
            F.array_join(F.slice(F.col("w"), x["i"] + 2, F.lit(NEIGHBOURS)), " ").alias("after"),
        ),
    )
    found = rows.select("doc_id", "path", F.explode(around).alias("x")).select("doc_id", "path", "x.*")
    long = F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))
    extra = F.when((F.col("short") != "") & ~F.col("short").rlike(CANDIDATE), F.array("short")).otherwise(F.array().cast("array<string>"))
    each = found.select("doc_id", "path", "i", "word", "before", "after", F.posexplode(F.concat(long, extra)).alias("nth", "candidate"))
    return each.select("doc_id", F.col("i").cast("long").alias("word_index"), F.col("nth").cast("long"), "candidate", "word", "before", "after", "path")


def _pick(seed: str, options: list[str]) -> Column:
    """One of ``options`` by a hash of the row's number."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(len(options))) + 1).cast("int"))


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(label, candidate, word, before, after, path): made-up secrets and made-up false alarms, the same at every call."""
    digest = lambda seed: F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    syllables = ["tion", "the", "er", "an", "ou", "ing", "re", "en", "ha", "ble", "st", "ly", "nd", "ment", "ver", "lich", "heit", "ciones", "eau", "que", "dor", "sch", "ung", "ado"]
    parts = {
        "hexes": F.substring(digest("h"), 1, 40),
        "base64": F.regexp_replace(F.base64(F.unhex(digest("b"))), "[=/+]", "Q"),
        "long_word": F.concat(*(_pick(f"s{i}", syllables) for i in range(8))),
        "short_word": F.concat(*(_pick(f"w{i}", syllables) for i in range(3))),
        "prose": F.concat_ws(" ", *(F.concat(_pick(f"p{i}", syllables), _pick(f"q{i}", syllables)) for i in range(3))),
        "named": _pick("k", ["token", "api_key", "secret", "password", "access_key", "auth_token", "Token", "TOKEN", "client_secret", "SECRET_KEY"]),
        "hashed": _pick("hk", ["commit", "sha1", "checksum", "md5", "revision", "digest", "uuid", "integrity", "sha256", "etag"]),
        "quote": _pick("quote", ['"', '"', "'", ""]),
        "sign": _pick("sign", ["=", ":", "=", ":="]),
        "tail": _pick("tail", ["", ",", "###", "!!", "***", "."]),
        "any_path": _pick("path", ["src1", "src7", "app/config.py", "deploy/.env", "settings.yaml", "notes/page.txt", ""]),
        "dull_path": _pick("wpath", ["src1", "src7", "package-lock.json", "go.sum", "tests/fixtures/a.txt", "docs/example.md", "dist/app.min.js", ""]),
        "numbers": F.regexp_replace(digest("n"), "[a-f]", "7"),
        "dashed": F.concat_ws("-", *(F.substring(digest("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        "prefix": _pick("pre", ["ghp_", "sk_live_", "glpat-", "xoxb-"]),
        "stand_in": F.concat(_pick("ex", ["EXAMPLE", "your_api_key_", "xxxxxxxxxxxx", "placeholder"]), F.lit("00000000000000")),
        "noun": _pick("noun", ["get", "user", "value", "image", "page", "file"]),
        "symbol": _pick("symbol", ["&", "#", "!", "$", "@", "%", "*", "?"]),
        "letters": F.regexp_replace(F.base64(F.unhex(digest("c"))), "[=/+]", "q"),
        "blank": _pick("blank", ["required", "undefined", "expired", "disabled", "optional", "rejected", "internal", "anonymous"]),
    }
    rows = written(spark.range(0, n, 1, 1).select("id", *(c.alias(name) for name, c in parts.items())), "finding-parts")
    c = F.col
    joined = lambda *x: F.concat_ws(" ", *x)
    telling, plain = joined("prose", "named", "sign"), c("prose")
    kinds = [
        # label, candidate, before, path
        (1, c("hexes"), telling, "any_path"),
        (1, F.upper("hexes"), F.upper(telling), "any_path"),
        (1, F.substring("base64", 1, 32), telling, "any_path"),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring("base64", 1, 16))), joined("prose", "sign"), "any_path"),
        (1, F.concat("prefix", F.substring("base64", 1, 30)), plain, "any_path"),
        (1, c("base64"), joined("prose", "named"), "any_path"),
        (0, c("hexes"), joined("prose", "hashed", "sign"), "dull_path"),
        (0, c("long_word"), plain, "any_path"),
        (0, F.initcap("long_word"), telling, "any_path"),
        (0, F.upper("long_word"), F.upper(plain), "any_path"),
        (0, F.concat_ws("_", "short_word", "noun", "long_word"), plain, "dull_path"),
        (0, F.concat_ws("/", F.lit(""), "short_word", "noun", "long_word"), plain, "dull_path"),
        (0, c("numbers"), plain, "any_path"),
        (0, c("stand_in"), telling, "dull_path"),
        (0, c("dashed"), joined("prose", F.lit("id")), "any_path"),
        (0, F.concat_ws("-", "short_word", "long_word", "noun"), plain, "dull_path"),
        (0, F.rpad(F.lit("="), 24, "=-"), plain, "any_path"),
        (1, F.substring("hexes", 1, 16), telling, "any_path"),
        (1, F.concat(F.initcap("short_word"), F.substring("numbers", 1, 2), "symbol", F.substring("hexes", 1, 3)), telling, "any_path"),
        (1, F.concat(F.substring("letters", 1, 5), "symbol", F.substring("letters", 9, 5), F.substring("numbers", 1, 2)), telling, "any_path"),
        (1, F.concat(F.substring("letters", 1, 11), F.substring("numbers", 1, 1)), telling, "any_path"),
        (0, F.concat("noun", "short_word"), telling, "any_path"),
        (0, F.concat_ws("-", "blank", "noun"), telling, "any_path"),
        (0, F.concat_ws(".", "noun", "short_word"), telling, "any_path"),
        (0, F.concat(F.lit("$"), F.upper(F.concat_ws("_", "noun", "short_word"))), telling, "dull_path"),
        (0, F.concat(F.lit("//"), "noun", "short_word", F.lit(".com")), telling, "any_path"),
        (0, F.concat(F.lit("changeme"), F.substring("numbers", 1, 2)), telling, "dull_path"),
        (0, F.lit("********"), telling, "any_path"),
    ]
    which = F.pmod("id", F.lit(len(kinds)))
    made = reduce(lambda so_far, x: so_far.when(which == x[0], F.struct(F.lit(float(x[1][0])).alias("label"), x[1][1].alias("candidate"), x[1][2].alias("before"), c(x[1][3]).alias("path"))), enumerate(kinds), F)
    flat = rows.select(made.alias("x"), "quote", "tail", plain.alias("after")).select("x.*", "quote", "tail", "after")
    return flat.select("label", "candidate", F.concat("quote", "candidate", "quote", "tail").alias("word"), "before", "after", "path")


def fit_forest(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from (label, candidate, word, before, after, path). Rows without a label are left out."""
    rows = written(featured(findings.where("label is not null")).select("label", *FEATURES), "findings")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", cacheNodeIds=False).fit(vectors)


def secret_findings(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, word_index, nth, candidate, word, before, after, path, score, is_secret) for each candidate of ``docs``.

    Null and empty texts have no candidates; null paths count as empty, null ids
    stay null. Repeated rows give repeated findings; of equal candidates in one
    text each is a finding. Texts of any length are read whole. An empty table
    gives an empty one. Columns other than the three named aren't read. ``word_index``
    counts words cut at white space from 0, ``nth`` the candidates of a word.
    """
    model = fit_forest(findings)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(candidates(docs, id_col, text_col, path_col)))
    scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word_index", "nth", "candidate", "word", "before", "after", "path", "score", (F.col("score") >= 0.5).alias("is_secret"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the whole ``documents`` table with the forest's verdicts; of the candidate itself its length and SHA-256."""
    found = secret_findings(table(spark, sf_dir, "documents"), labelled_findings(spark))
    return found.select("doc_id", "word_index", "nth", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
