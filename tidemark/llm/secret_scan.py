"""Secret scanning with a random forest that removes false positives, in DataFrame operations only.

Candidates are taken widely: runs of 16 or more key characters that hold a digit, keys with an issuer's prefix, and
whatever of 6 or more characters is assigned to a word that announces a secret (``password=``, ``token: "``, ...).
The forest looks at a candidate's length and character mix, the transitions between characters, how much of it
the corpus's own frequent words cover, whether it stands in a path, and the words beside it. It is trained on
labelled findings; ``labelled_findings`` makes a set of them by rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

_KEY = r"[A-Za-z0-9+/_\-]"
_SECRET = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\- ]?key|auth(?:orization)?|credentials?|(?:private|access|client|secret)[_\- ]?key)"
#: A word that announces a secret, and what stands between it and the value.
_ASSIGNED = rf"(?=[pP][aAwWrR]|[sS][eE]|[tT][oO]|[aA][pPuUcC]|[cC][rRlL]|[bB][eEaA])(?i:{_SECRET}[\"'`]?\s*+(?:(?::=|=>|->|==?|:)\s*+[\"'`]?|[\"'`]|(?:is|was)\s++[\"'`]?)|\b(?:bearer|basic)\s++)"
#: An assigned value: up to eight words that a quote closes, or all up to a blank, a quote or a bracket.
_QUOTED = r"(?<={0})(?=[^{0}\r\n]{{6}})[^\s{0}]++(?:[ \t][^\s{0}]++){{0,7}}+(?={0})"
_VALUE = rf"(?:{_QUOTED.format(chr(34))}|{_QUOTED.format(chr(39))}|[^\s\"'`,;<>(){{}}\[\]]{{5,}}[^\s\"'`,;<>(){{}}\[\].:?])"
#: A key with an issuer's prefix, with or without digits; dots for signed tokens.
_PREFIXED = rf"(?<!{_KEY})(?:(?:AKIA|ASIA)[A-Z0-9]{{16,}}+|AIza{_KEY}{{16,}}+|gh[pousr]_{_KEY}{{16,}}+|glpat-{_KEY}{{12,}}+|xox[abprs]-{_KEY}{{10,}}+|sk_(?:live|test)_{_KEY}{{10,}}+|eyJ{_KEY}{{8,}}+(?:\.{_KEY}++){{1,4}}+)"
#: A run of key characters with a digit, unless it ends as a word that has a value of its own.
_RUN = rf"(?<!{_KEY})(?=[A-Za-z+/_\-]*+[0-9]){_KEY}{{16,}}+(?<!(?i:word|passwd|phrase|pwd|secret|token|key))={{0,2}}"
CANDIDATE = rf"{_ASSIGNED}{_VALUE}|{_PREFIXED}|{_RUN}"
#: A text without any of these has no candidate: a run that might be one, a part of an announcing word, an issuer's prefix.
_SOME_RUN = rf"(?<!{_KEY})(?=[A-Za-z+/_\-]*+[0-9]){_KEY}{{16}}"
_SOME_WORD = ("pass", "pwd", "secret", "token", "auth", "credential", "key", "bearer", "basic")
_SOME_PREFIX = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "sk_", "eyJ")
_SECRET_WORD = rf"(?i)({_SECRET}|bearer|basic)[^A-Za-z0-9]{{0,6}}((is|was)\s+[\"'`]?)?$"
_PASSWORD_WORD = r"(?i)(pass(word|wd|phrase)?|pwd)[^A-Za-z0-9]{0,6}((is|was)\s+[\"'`]?)?$"
_PLAIN_WORD = r"(?i)(commit|revision|sha-?[0-9]*|md5|checksum|hash|digest|uuid|guid|etag|id|doi|isbn|serial|order|invoice|number|build|version|ref|card|account)[^A-Za-z0-9]{0,6}$"
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_ISSUED = r"^(AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abprs]-|sk_(live|test)_|eyJ)"
#: What stands for a value that is not given.
_STAND_IN = r"(?i)^([*xX.#_\-]+|[<$%{].*|.*[>})]|.*\.env\..*|none|null|nil|true|false|undefined|unknown|required|optional|example|your.*|my.*here|.*placeholder.*|change.?me|redacted|hidden|string|varchar.*)$"
FEATURES = (
    "size", "digits", "uppers", "lowers", "hexes", "marks", "others", "blanks", "distinct", "turns", "letter_pairs", "longest_word",
    "coverage", "slashes", "in_path", "secret_word", "password_word", "plain_word", "assigned", "quoted", "issued", "uuid", "numeric", "stand_in",
)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start_char, end_char, value, left, right: every candidate of every whole text.

    Characters count from 0. Null and empty texts have none. A repeated row has its candidates again.
    """
    # cheap tests first, as most texts hold nothing of the kind
    low = F.lower("text")
    some = [*(low.contains(x) for x in _SOME_WORD), *(F.col("text").contains(x) for x in _SOME_PREFIX), F.col("text").rlike(_SOME_RUN)]
    some = docs.select("doc_id", "text").where(reduce(lambda a, b: a | b, some))
    held = some.where(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    split = held.select(
        "doc_id", "row", F.md5("text").alias("text_hash"), F.split("text", CANDIDATE, -1).alias("around"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
    )
    each = split.select("doc_id", "row", "text_hash", "around", F.posexplode("found").alias("nth", "whole"))
    before, after = F.get("around", F.col("nth")), F.get("around", F.col("nth") + 1)
    # an assigned value is judged without the word that announces it, which stands to its left
    value = F.regexp_replace("whole", rf"^{_ASSIGNED}", "")
    each = each.select(
        "row", "doc_id", "text_hash", "nth", "whole", value.alias("value"), F.length(before).alias("gap"), F.right(before, F.lit(48)).alias("before"),
        F.left(after, F.lit(24)).alias("right"),
    )
    order = Window.partitionBy("row").orderBy("nth")  # one text's candidates
    end = F.sum(F.col("gap") + F.length("whole")).over(order)
    announced = F.concat("before", F.expr("left(whole, length(whole) - length(value))"))
    each = each.withColumn("end_char", end).withColumn("left", F.right(announced, F.lit(48)))
    return each.select("doc_id", "text_hash", (F.col("end_char") - F.length("value")).alias("start_char"), "end_char", "value", "left", "right")


def corpus_dictionary(docs: DataFrame, least_share: float = 1e-3) -> DataFrame:
    """Words (a-z, three letters or more) that stand in at least ``least_share`` of the texts.

    Their number cannot exceed a text's mean number of different words divided by that share.
    """
    texts = docs.select("text").where("text is not null")
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).where(F.length("word") >= 3)
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return written(counts.where(F.col("n") >= texts.count() * least_share).select("word"), "dictionary")


def _coverage(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """coverage: the share of a value's characters in letter runs that are dictionary words."""
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    known = runs.join(dictionary, "word", "left_semi").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    return found.join(known, "value", "left").withColumn("coverage", F.coalesce("covered", F.lit(0)) / F.length("value")).drop("covered")


def features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``found`` (value, left, right, ...) with the forest's columns, all doubles."""
    v, size = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / size
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    longest = F.array_max(F.transform(F.regexp_extract_all("value", F.lit("[A-Za-z]+"), F.lit(0)), F.length))
    columns: dict[str, Column] = {
        "size": F.least(size, F.lit(128.0)), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "hexes": share("[0-9a-f]"), "marks": share(r"[+/_\-]"),
        "others": share(r"[^A-Za-z0-9+/_\-\s]"), "blanks": share(r"\s"), "stand_in": flag(v.rlike(_STAND_IN)), "password_word": flag(F.col("left").rlike(_PASSWORD_WORD)),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(64.0)),
        "turns": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"), "letter_pairs": share("[a-z](?=[a-z])|[A-Z](?=[A-Z])"),
        "longest_word": F.coalesce(F.least(longest, F.lit(64)), F.lit(0)).cast("double"), "slashes": F.least(F.regexp_count("value", F.lit("/")), F.lit(8)).cast("double"),
        "in_path": flag(F.col("left").rlike(r"(?i)(://[^\s]*|[/\\.~])$") | F.col("right").rlike(r"^(/|\.[A-Za-z])")),
        "secret_word": flag(F.col("left").rlike(_SECRET_WORD)), "plain_word": flag(F.col("left").rlike(_PLAIN_WORD)),
        "assigned": flag(F.col("left").rlike(r"[=:]\s*[\"'`]?$")), "quoted": flag(F.col("left").rlike(r"[\"'`]$") & F.col("right").rlike(r"^[\"'`]")),
        "issued": flag(v.rlike(_ISSUED)), "uuid": flag(v.rlike(_UUID)), "numeric": flag(v.rlike(r"^[0-9_\-]+=*$")),
    }
    return _coverage(found, dictionary).withColumns(columns)


def labelled_findings(spark: SparkSession, rows: int = 8192, words: tuple[str, ...] = ()) -> DataFrame:
    """value, left, right, label: findings made by rule from hashes of their numbers, about half of them secrets.

    Secrets: issued and signed keys anywhere; random strings of several alphabets, passwords and pass phrases beside
    a word that announces them. Others: digests, identifiers and numbers beside words that announce those or nothing,
    paths, links, names with versions; and, announced as secrets, plain words, stand-ins, paths and expressions.
    ``words`` are common words of the corpus, for names and phrases.
    """
    n, own = F.col("id"), (*words, "report", "release", "backup", "session", "dataset", "winter", "garden", "market", "letter", "station", "people", "number")
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), draw(salt, len(of)) + 1)
    size = lambda lo, hi: draw(lo, hi - lo + 1) + lo
    part = lambda text, length: F.substring(text, F.lit(1), length)
    word = lambda salt: pick(salt, *own)
    hexes = F.concat(*(F.sha2(F.concat(F.lit(x), n.cast("string")), 256) for x in "abc"))
    upper, digits = F.translate(hexes, "0123456789abcdef", "7QX2ZKM5JDW4RTHN"), F.translate(hexes, "abcdef", "123456")
    letters = F.translate(hexes, "0123456789abcdef", "qGtbVnZkRmWxpLsd")
    mixed = F.regexp_replace(F.base64(F.unhex(hexes)), "[+/=]", "")
    marked = F.translate(mixed, "aeiAEIswq", "!@#$%^&*?")
    name = F.concat(word(5), F.lit("_"), word(6), pick(7, "_version_20", "_v1_", "-20", "_"), part(digits, F.lit(2)))
    prose = pick(8, " and the ", "see also ", "was found in ", "then ", "", "with ")
    keyword = pick(
        9, "password=", "passwd: ", "token = \"", "secret: '", "api_key=", "API_KEY = \"", "Authorization: ", "access_key: ", "client_key=\"", "pwd=",
        "Bearer ", "secret is ",
    )
    secret_end = pick(9, "", "", "\" ", "' ", "", "\"", " ", " ", "\"", "", " ", " ")
    password = pick(10, "password=", "password: ", "passwd = \"", "pwd=", "Password: '", "pass=", "the password is ", "PASSWORD=\"", "passphrase: \"")
    password_end = pick(10, "", " ", "\"", ";", "' ", "&", " ", "\"", "\" ")
    phrase_start, phrase_end = pick(11, "passphrase = \"", "password: \"", "pass phrase is \"", "secret='"), pick(11, "\"", "\" ", "\"", "'")
    plain = pick(12, "commit ", "sha256: ", "md5=", "checksum ", "uuid ", "id=", "order ", "revision ", "etag: \"", "build ", "digest = \"", "number ")
    said = pick(13, "password: ", "the token: ", "secret: ", "a token is ", "the password is ", "token=", "Password: \"", "authorization: ", "basic ", "the secret was ")
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    phrase = F.replace(F.concat_ws(" ", word(15), word(16), word(17), word(18)), F.lit(" "), pick(14, " ", "-", " ", "_"))
    kinds = [
        (1, F.concat(pick(19, "AKIA", "ASIA"), part(upper, F.lit(16))), prose, F.lit(" in")),
        (1, part(hexes, size(16, 64)), keyword, secret_end),
        (1, part(mixed, size(20, 44)), keyword, secret_end),
        (1, F.concat(pick(20, "ghp_", "gho_", "xoxb-", "sk_live_", "glpat-", "AIza"), part(F.when(n % 3 == 0, letters).otherwise(mixed), size(24, 36))), pick(21, " ", "token: ", "key=", "use "), F.lit(" ")),
        (1, part(hexes, F.lit(40)), F.lit("token = \""), F.lit("\" ")),
        (1, F.concat(part(mixed, size(18, 30)), F.lit("0x9")), F.concat(prose, F.lit("the secret ")), F.lit(" ")),
        (1, F.concat(F.when(n % 2 == 0, F.initcap(word(22))).otherwise(word(22)), part(digits, size(1, 4)), pick(23, "", "", "!", "@", "#", "$x", "?!")), password, password_end),
        (1, part(F.when(n % 2 == 0, marked).otherwise(mixed), size(7, 15)), password, password_end),
        (1, phrase, phrase_start, phrase_end),
        (1, F.concat(F.lit("eyJhbGciOi"), part(mixed, size(10, 20)), F.lit(".eyJ"), F.substring(mixed, 3, 30), F.lit("."), F.substring(mixed, 20, 40)), pick(24, "Bearer ", " ", "token=", "jwt "), F.lit(" ")),
        (1, part(letters, size(16, 36)), keyword, secret_end),
        (1, part(marked, size(16, 30)), keyword, secret_end),
        (0, part(hexes, F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), (n % 3 + 1).cast("int"))), plain, F.lit(" ")),
        (0, F.when(n % 2 == 0, uuid).otherwise(part(hexes, F.lit(40))), F.concat(prose, pick(25, "id ", "uuid: ", "", "ref ")), F.lit(" ")),
        (0, F.concat(F.lit("usr/share/"), name), F.lit(" /"), F.lit(".txt")),
        (0, F.concat(F.lit("articles/20"), part(digits, F.lit(2)), F.lit("/"), name), F.lit("https://www.example.com/"), F.lit("/")),
        (0, part(digits, size(16, 24)), F.concat(prose, pick(26, "card ", "account ", "", "order number ", "call ")), F.lit(" ")),
        (0, F.concat(word(27), F.lit("-"), name, F.lit("-rev"), part(digits, F.lit(1))), prose, F.lit(", ")),
        (0, F.concat(word(28), F.when(n % 3 == 0, word(29)).otherwise(F.lit(""))), said, pick(30, " ", " and", " ", "\"")),
        (0, pick(31, "********", "xxxxxxxx", "required", "optional", "<password>", "${DB_PASSWORD}", "process.env.TOKEN", "undefined", "changeme", "your-token-here", "REDACTED", "string", "example"), F.when(n % 2 == 0, said).otherwise(password), F.lit(" ")),
        (0, F.concat(pick(32, "/var/run/", "/etc/", "../", "https://www."), word(33), pick(34, "/", ".example.com/", "/conf/"), name), F.when(n % 2 == 0, said).otherwise(keyword), F.lit(" ")),
        (0, F.concat(pick(35, "request.", "os.environ", "config.", "self.", "get"), pick(36, "token", "getenv", "password", "read", "value")), F.when(n % 2 == 0, said).otherwise(keyword), pick(37, "(", "[", "()", ";")),
        (0, F.concat(word(38), F.lit(" "), word(39), F.lit(" "), pick(40, "must be", "has to be", "is not", "can be", "will be"), F.lit(" "), word(41), F.lit(" "), pick(42, "again", "here", "soon", "there")), F.lit("the password: \""), F.lit("\"")),
        (0, F.replace(F.concat(F.lit("20"), part(digits, F.lit(2)), F.lit(" "), word(44), F.lit(" "), word(45)), F.lit(" "), pick(43, "-", "/", "_")), F.concat(prose, pick(46, "", "file ", "see ", "token ")), F.lit(" ")),
    ]
    part_of = lambda k, x: spark.range(k, rows, len(kinds), 1).select(
        x[1].alias("value"), x[2].alias("left"), x[3].alias("right"), F.lit(float(x[0])).alias("label"),
    )
    return reduce(DataFrame.unionByName, (part_of(k, x) for k, x in enumerate(kinds)))


def train(findings: DataFrame, dictionary: DataFrame, trees: int = 40, depth: int = 8, seed: int = 11) -> PipelineModel:
    """A forest from labelled ``findings`` (value, left, right, label 0/1)."""
    rows = written(features(written(findings, "findings"), dictionary), "labelled")  # read several times below
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(FEATURES), outputCol="__features"),
            RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed),
        ]
    ).fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, start_char, end_char, value, kind, score, is_secret: every candidate, judged.

    ``findings`` are labelled examples; without any, those of ``labelled_findings``. is_secret is score >= 0.5.
    Null and empty texts give no rows, an empty table none. Columns besides doc_id and text are not read.
    """
    dictionary = corpus_dictionary(docs)
    if findings is None:
        some = dictionary.where("length(word) > 3").orderBy(F.xxhash64("word")).limit(64).collect()
        findings = labelled_findings(docs.sparkSession, words=tuple(r["word"] for r in some))
    model = train(findings, dictionary)
    # written, as the features read them twice
    judged = model.transform(features(written(candidates(docs), "candidates"), dictionary)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    kind = F.when(F.col("issued") > 0, "issued key").when(F.col("uuid") > 0, "uuid").when(F.col("numeric") > 0, "number").when(
        F.col("hexes") + F.col("marks") >= 0.999, "hexadecimal",
    ).otherwise("mixed")
    return judged.select(
        "doc_id", "text_hash", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"), "value",
        kind.alias("kind"), "score", (F.col("score") >= 0.5).alias("is_secret"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", findings: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``mark`` in place of every secret found: at its own places, and at the other places of that text where
    the same value stands as a candidate. The same letters inside a longer word stay.

    n_chars, if there, is counted anew for changed texts. All rows and columns stay.
    """
    spans = scan(docs, findings).groupBy("text_hash", "value").agg(F.max("is_secret").alias("secret"), F.collect_set(F.struct("start_char", "end_char")).alias("at"))
    found = spans.where("secret").groupBy("text_hash").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("__secrets"))
    found = written(found, "secrets").withColumnRenamed("text_hash", "__hash")
    joined = docs.join(found, F.md5(docs["text"]) == F.col("__hash"), "left")
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x["start_char"] < s["at"], s).otherwise(F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start_char"] - s["at"]), F.lit(mark)).alias("out"), x["end_char"].alias("at")))
    clean = F.aggregate("__secrets", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    joined = joined.withColumn("text", F.when(F.col("__secrets").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col("__secrets").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return joined.select(docs.columns)
