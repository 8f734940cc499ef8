"""Secret scanning with a random forest against false positives, in DataFrame operations only.

Candidates are long unbroken strings and values assigned to telling names.  Each is described by its
length, its transitions between kinds of characters, how much of it common words cover, whether it
looks like a path or stands in one, and the words beside it.  A random forest, trained on labelled
findings, tells secrets from hashes, ids, paths and plain words.  The labelled findings are generated
(labelled): real ones cannot be shipped, and the rules that make each kind are plain to read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import matches

#: Production parameters.  FINDINGS bounds what the forest is trained on.
FINDINGS = 6000
TREES = 40
DEPTH = 8
SEED = 17
THRESHOLD = 0.5
#: Code points of context kept on each side of a candidate.
NEAR = 48

#: A run of 16 or more characters keys are made of, padding at its end, or 8 or more after an assignment
#: to a name.  A name and its = are no part of the value.
CANDIDATE = r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}(?:={1,2}(?![A-Za-z0-9+/=]))?|(?<=[:=][\x20\"']{0,3})(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.=!@#$%^&*-]{8,}"
#: Words that name a secret, words that name something else of that look, and formats.
SECRET_NAMES = "token|secret|passw|pwd|api.?key|apikey|access.?key|private.?key|auth|bearer|credential|client.?secret|signature|license.?key"
OTHER_NAMES = "sha1|sha256|sha512|md5|hash|digest|checksum|commit|revision|etag|uuid|guid|serial|isbn|build|version|image|path|file|src|href|url|http"
FORMATS = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{30,}$|^eyJ[A-Za-z0-9_=-]{10,}\.|^sk[-_](?:live|test)?[-_]?[A-Za-z0-9]{20,}$|^glpat-"
COMMON = (
    "about|after|again|also|back|been|before|black|book|build|call|case|change|city|class|close|code|come|could|data|default|does|down|each|even|every|example|field|file|find|first|from|good|great|group|hand|have|head|help|here|high|home|house|image|index|into|just|know|large|last|learn|left|life|light|like|line|list|little|local|long|look|made|main|make|many|more|most|move|much|must|name|never|news|next|node|number|only|open|other|over|page|part|path|people|place|plain|point|public|read|right|same|school|second|server|should|show|side|small|some|sound|source|spell|start|state|still|story|string|study|such|system|table|take|tell|test|text|than|that|their|them|then|there|these|they|thing|think|this|time|turn|type|under|user|value|very|view|want|water|well|were|what|when|where|which|while|white|will|with|word|work|world|would|write|year|your|tion|ing|ment|and|the|for|not"
)
FEATURES = ["length", "transitions", "digits", "uppers", "hex_only", "distinct", "coverage", "vowels", "slashes", "dots", "separators", "extension", "in_path", "named_secret", "named_other", "assigned", "quoted", "format", "longest_letters"]


def _share(value: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def described(rows: DataFrame) -> DataFrame:
    """rows (value, before, after) with FEATURES as doubles."""
    v, low = F.col("value"), F.lower(F.col("value"))
    before, after = F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("after", F.lit("")))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a"), "[^9Aa]+", ".")
    near = F.right(before, F.lit(32))
    made = {
        "length": F.least(F.length(v), F.lit(200)),  # beyond it length tells no more
        "transitions": (F.length(kinds) - 1) / F.length(v),
        "digits": _share(v, "[0-9]"),
        "uppers": _share(v, "[A-Z]"),
        "hex_only": low.rlike("^[0-9a-f]+$"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.length(v), F.lit(40)),
        "coverage": _share(low, COMMON),
        "vowels": _share(low, "[aeiou]"),
        "slashes": F.length(F.regexp_replace(v, "[^/]", "")),
        "dots": F.length(F.regexp_replace(v, "[^.]", "")),
        "separators": _share(v, "[_.=+/-]"),
        "extension": low.rlike(r"\.[a-z]{2,5}[0-9]?$"),
        "in_path": before.rlike(r"[/\\]\S*$|://\S*$") | after.rlike(r"^[/\\]"),
        "named_secret": near.rlike(f"(?:{SECRET_NAMES})[a-z0-9_\"'-]*[\\s:=>\"']*$"),
        "named_other": near.rlike(f"(?:{OTHER_NAMES})[a-z0-9_\"'-]*[\\s:=>\"'-]*$"),
        "assigned": before.rlike("[:=]>?\\s*[\"'`]?$"),
        "quoted": before.rlike("[\"'`]$") & after.rlike("^[\"'`]"),
        "format": v.rlike(FORMATS),
        "longest_letters": F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), F.length)),
    }
    return rows.select("*", *[F.coalesce(made[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def labelled(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n labelled findings: value, before, after, label.

    Half are secrets (hex, base-64 and prefixed keys and mixed passwords, mostly assigned to a telling
    name), half look-alikes: digests and revisions under their names, UUIDs, paths and file names,
    long words (common and invented ones) and identifiers, numbers, rulers, and keys' formats in paths.  Which kind a row is and
    its letters follow from hashes of its number."""
    i = F.col("id")
    h = lambda k: F.sha2(F.concat_ws(":", i.cast("string"), F.lit(str(k))), 256)
    hex40, hex32, hex64 = F.substring(h(1), 1, 40), F.substring(h(2), 1, 32), h(3)
    b64 = F.regexp_replace(F.base64(F.unhex(h(4))), "=", "")
    upper = F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(h(5))), "[^A-Za-z0-9]", ""), 1, 16))
    pick = lambda k, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    word = lambda k: pick(k, *COMMON.split("|")[:120])
    sound = lambda k: F.concat(pick(k, *"b d f g k l m n p r s t v z st tr br".split()), pick(k + 1, *"a e i o u ei ou an en or".split()))
    sounds = lambda *ks: F.concat(*[sound(k) for k in ks])
    words = lambda sep, *ks: F.concat_ws(sep, *[word(k) for k in ks])
    name = pick(20, "token", "secret", "password", "api_key", "apikey", "access_key", "AUTH_TOKEN", "client_secret", "aws_secret_access_key", "passwd", "Authorization", "private_key")
    other = pick(21, "sha1", "sha256", "md5", "commit", "checksum", "digest", "revision", "etag", "hash", "build")
    set_to = pick(22, " = \"", "=\"", ": \"", "='", ": ", "=", " = ")
    plain = F.concat(words(" ", 30, 31, 32), F.lit(" "))
    close = F.when(set_to.contains("\""), F.lit("\" ")).when(set_to.contains("'"), F.lit("' ")).otherwise(F.lit(" "))
    secret_ctx, other_ctx = F.concat(plain, name, set_to), F.concat(plain, other, set_to)
    good = [
        (hex40, secret_ctx, close), (hex32, secret_ctx, close), (hex64, secret_ctx, close), (b64, secret_ctx, close), (F.upper(hex40), F.upper(secret_ctx), close),
        (F.concat(F.lit("AKIA"), upper), plain, F.lit(" ")), (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(F.concat(b64, hex40), "[^A-Za-z0-9]", "x"), 1, 36)), plain, F.lit(" ")),
        (F.concat(F.lit("sk_live_"), F.substring(hex40, 1, 24)), secret_ctx, close), (F.substring(b64, 1, 20), secret_ctx, close), (F.concat(F.substring(b64, 1, 9), pick(23, "!", "#", "$", "9"), F.substring(hex40, 1, 3)), secret_ctx, close),
    ]
    uuid = F.concat_ws("-", F.substring(hex40, 1, 8), F.substring(hex40, 9, 4), F.substring(hex40, 13, 4), F.substring(hex40, 17, 4), F.substring(hex40, 21, 12))
    bad = [
        (hex40, other_ctx, close), (hex64, other_ctx, close), (hex32, other_ctx, close), (uuid, pick(24, plain, other_ctx), F.lit(" ")),
        (F.concat(F.lit("/"), words("/", 40, 41, 42, 43)), plain, F.lit(" ")), (F.concat(words("/", 44, 45, 46), F.lit("."), pick(25, "html", "png", "js", "py", "txt")), plain, F.lit(" ")),
        (words("", 47, 48, 49, 50), plain, F.lit(" ")), (words("_", 51, 52, 53, 54), pick(26, plain, secret_ctx), F.lit(" ")), (words("-", 55, 56, 57, 58), plain, F.lit(".")),
        (F.regexp_replace(h(6), "[a-f]", ""), plain, F.lit(" ")), (F.repeat(pick(27, "-", "=", "_", ".", "x"), 24), plain, F.lit(" ")), (hex40, F.concat(plain, F.lit("https://"), word(59), F.lit(".com/")), F.lit("/")),
        (words(".", 60, 61, 62, 63), plain, F.lit(" ")), (words("", 64, 65, 66), secret_ctx, close), (F.concat(words("", 67, 68), F.lit("@"), word(69), F.lit(".com")), plain, F.lit(" ")),
        (sounds(100, 102, 104, 106, 108, 110, 112), pick(28, plain, ""), F.lit(" ")), (F.initcap(sounds(114, 116, 118, 120, 122, 124, 126)), pick(29, plain, ""), F.lit(" ")),
        (F.upper(sounds(154, 156, 158, 160, 162, 164)), F.upper(plain), pick(72, " ", "!! ", ". ")),
        (F.concat(sounds(128, 130, 132, 134), pick(70, "-", ".", "/", "_", "..."), sounds(136, 138, 140, 142)), plain, F.lit(" ")), (sounds(144, 146, 148, 150, 152), F.concat(plain, word(71), F.lit(": ")), F.lit(" ")),
    ]
    struct = lambda x, label: F.struct(x[0].alias("value"), x[1].alias("before"), x[2].alias("after"), F.lit(label).alias("label"))
    of = lambda xs, label: F.element_at(F.array(*[struct(x, label) for x in xs]), (F.pmod(F.xxhash64(i, F.lit(99)), F.lit(len(xs))) + 1).cast("int"))
    return spark.range(n).select(F.when(i % 2 == 0, of(good, 1.0)).otherwise(of(bad, 0.0)).alias("f")).select("f.*")


def trained(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """The forest of labelled findings (value, before, after, label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(findings)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, minInstancesPerNode=3, subsamplingRate=0.8).fit(rows.coalesce(1))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, value, before, after of every candidate in (doc_id, text); code points, end exclusive.

    before and after reach to the neighbouring candidates at most, and no candidate carries its text."""
    t = F.col("text")
    hint = t.rlike("[A-Za-z0-9+/_.=-]{16}|[:=][\\x20\"']{0,3}[A-Za-z0-9+/_.=!@#$%^&*-]{8}")
    near = F.transform(matches(t, CANDIDATE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.right(x["left"], F.lit(NEAR)).alias("before"), F.left(x["right"], F.lit(NEAR)).alias("after")))
    return docs.select("doc_id", F.explode(F.when(hint, near)).alias("c")).select("doc_id", "c.*")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, value_sha256, length, score, is_secret of every candidate in whole texts.

    Texts without candidates, null texts and empty texts give no rows; a null id stays null; repeated
    rows give repeated findings; other columns are not read.  Values themselves are not returned."""
    spark = docs.sparkSession
    model = trained(labelled(spark) if findings is None else findings)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(described(candidates(src)))
    score = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("length"), score.alias("score"), (score >= threshold).alias("is_secret"))
