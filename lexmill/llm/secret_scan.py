"""Secret scan with DataFrame expressions only: candidates, features and a random forest that removes false positives.

Candidates are taken widely: every long run with a digit or both cases, and every
value that a name such as password announces; the forest decides.

The forest is fitted by Spark's MLlib on labelled findings and turned into a
column expression, so that a document is scanned, judged and masked in one pass
without exploding its words.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs this long that have a digit or mix cases are candidates, and values this long that a name or word announces; votes that make a secret; trees and their depth.
LEAST, LEAST_ANNOUNCED, VOTES, TREES, DEPTH = 16, 6, 0.5, 30, 7
MASK = "<secret>"
#: A run and what comes before it since the last one; so much of that is looked at.
PIECE, NEAR = r"(?s)\G(.*?)([A-Za-z0-9+/_\-.~%@:]{16,}={0,2})", 64
#: Words whose presence inside a candidate speaks against randomness.
DICTIONARY = "about access account action admin after agent alpha and api app archive article asset auth base beta block blog book build bundle button cache call camera cell center change chapter check class click client cloud code color column comment common component config contact content control copy core count create data date debug default delete demo design detail dev device document domain download draft edit editor element email end engine entry error event example export feature field file filter final first folder font footer for form format from front full function get group guide header help hidden hidden home host house http image import index info inner input install item java key label language last layout left level library light line link list load local login main manager map master media member menu message method mobile model module month name new news next node note number object old open option order package page panel parent part password path pattern photo plan player plugin point policy post press preview private process product profile project public query quick read record release report request resource response result review right root route row rule sample screen script search section select server service session set setting shell show side site size small source special src start state static status step story style summary support system table tag task team template test text that the theme thread time title token tool top total track type unit update upload url user util value version video view web week widget window with word work world year".split()
#: Words before a candidate that announce a secret, or a harmless identifier.
ANNOUNCE = "(?i)(pass(word|wd|phrase)?|secret|token|api.?key|access.?key|auth|bearer|credential|private.?key|pwd|client.?key)"
HARMLESS = "(?i)(commit|sha\\d*|md5|hash|checksum|digest|uuid|guid|version|revision|build|example|sample|isbn|ticket|order|invoice|session|trace|request|ref|path|file|url|href|src|id)\\b"
#: A name's assignment, what opens and makes a value, and words that can stand between a name and its value.
ASSIGN, OPEN, VALUE, BETWEEN = "[\"'\\\\]*[:=]+[>]?", "[\"'`\\\\(\\[{<]*", "([^\\s\"'`,;\\\\<>(){}\\[\\]]{6,})", "^([=:]+>?|->|is|was)$"
FEATURES = ("length", "digits", "uppers", "transitions", "distinct", "dictionary", "path", "announced", "harmless", "assigned", "shape", "run")


def parts_of(word: Column, before: Column) -> Column:
    """What runs needs of a word: itself, the words before, its runs and the text before each run."""
    return F.struct(word.alias("word"), before.alias("before"), F.regexp_extract_all(word, F.lit(PIECE), F.lit(1)).alias("gaps"), F.regexp_extract_all(word, F.lit(PIECE), F.lit(2)).alias("runs"))


def runs(p: Column) -> Column:
    """array<struct<secret,word,before>> of every run of parts_of that can be a secret; a name before = or : is cut off.

    before is the field's name where one is assigned, or else the end of what comes
    before the run in its word; the first run has the words before as well.
    """

    def one(r, k):
        tail = F.right(F.concat(F.when(k > 0, F.element_at(p["runs"], F.greatest(k, F.lit(1)))).otherwise(""), F.element_at(p["gaps"], k + 1)), F.lit(NEAR))
        name = F.regexp_extract(tail, "[A-Za-z0-9_.\\-]+[\"'\\\\]*[=:]+[\"'\\\\(\\[{<]*$", 0)
        near = F.regexp_replace(F.when(name != "", name).otherwise(tail), "[\"'`\\\\(\\[{<]+$", "")
        first = F.coalesce(F.when(k == 0, p["before"]), F.lit(""))
        return F.struct(F.regexp_replace(r, "^[A-Za-z_.\\-]{1,40}[=:]+(?=.{16})", "").alias("secret"), r.alias("word"), F.when(near == "", first).when(first == "", near).otherwise(F.concat_ws(" ", first, near)).alias("before"))

    return F.transform(p["runs"], one)


def is_candidate(word: Column) -> Column:
    """Whether a word has a run of LEAST characters, and a digit or both cases."""
    return (F.length(word) >= LEAST) & (word.rlike("[0-9]") | (word.rlike("[A-Z]") & word.rlike("[a-z]"))) & word.rlike("[A-Za-z0-9+/_\\-.~%@:]{16,}")


def announced(words: Column, i: Column, before: Column) -> Column:
    """array<struct<secret,word,before>> of the values that a name announces in word i (from 1): assigned in the word itself, or after a name that the words before end with; but for those that runs() gives."""
    word, last, other = F.get(words, i - 1), F.get(words, i - 2), F.get(words, i - 3)
    own = F.transform(F.regexp_extract_all(word, F.lit(f"{ANNOUNCE}{ASSIGN}{OPEN}{VALUE}"), F.lit(3)), lambda v: F.struct(v.alias("v"), F.call_function("substring_index", word, v, F.lit(1)).alias("name")))
    after = last.rlike(f"{ANNOUNCE}{ASSIGN}{OPEN}$") | (last.rlike(BETWEEN) & other.rlike(f"{ANNOUNCE}[\"'\\\\]*$"))
    alone = F.regexp_extract(word, f"^{OPEN}{VALUE}", 1)
    alone = F.when(F.coalesce(after, F.lit(False)) & (F.size(own) == 0), F.array(F.struct(alone.alias("v"), F.lit("").alias("name")))).otherwise(F.array().cast("array<struct<v:string,name:string>>"))
    cut = F.transform(F.concat(own, alone), lambda x: F.struct(F.regexp_replace(x["v"], "[.:?]+$", "").alias("secret"), F.regexp_replace(x["v"], "[.:?]+$", "").alias("word"), F.trim(F.concat_ws(" ", before, F.regexp_replace(x["name"], "[\"'`\\\\(\\[{<]+$", ""))).alias("before")))
    return F.filter(cut, lambda x: (F.length(x["secret"]) >= LEAST_ANNOUNCED) & ~(is_candidate(x["secret"]) & x["secret"].rlike("^[A-Za-z0-9+/_\\-.~%@:]{16,}={0,2}$")))


def features(cand: Column, word: Column, before: Column) -> list[Column]:
    """The features FEATURES of a candidate in its word after the words before (joined by spaces)."""
    n = F.greatest(F.length(cand), F.lit(1))
    share = lambda rx: F.length(F.regexp_replace(cand, rx, "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(cand, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0"), "[^aB0]+", "-")
    known = F.length(F.regexp_replace(F.lower(cand), f"({'|'.join(sorted({w for w in DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w)))})", ""))
    runs = F.transform(F.split(cand, "[^A-Za-z]+"), lambda x: F.length(x))
    shape = F.when(cand.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), 3).when(cand.rlike("^[0-9.:\\-/]+$"), 2).when(cand.rlike("^[0-9a-fA-F]+$"), 1).otherwise(0)
    return [
        n.cast("double"),
        share("[^0-9]"),
        share("[^A-Z]"),
        (F.length(kinds) - 1) / n,
        F.size(F.array_distinct(F.split(cand, ""))) / n,
        1 - known / n,
        (share("[^/.:@%]") + F.when(word.rlike("(?i)(https?|ftp|www\\.|^[./~]|\\.[a-z]{2,4}\\b)"), 1).otherwise(0)).cast("double"),
        F.when(F.concat_ws(" ", before, F.regexp_extract(word, "^([A-Za-z_.\\-]{1,40})[=:]", 1)).rlike(ANNOUNCE), 1.0).otherwise(0.0),
        F.when(F.concat_ws(" ", before, F.regexp_extract(word, "^([A-Za-z_.\\-]{1,40})[=:]", 1)).rlike(HARMLESS), 1.0).otherwise(0.0),
        F.when(F.concat(F.coalesce(before, F.lit("")), F.regexp_extract(word, "^[A-Za-z_.\\-]{0,40}[=:]*", 0)).rlike("[=:]$"), 1.0).otherwise(0.0),
        shape.cast("double"),
        F.coalesce(F.array_max(runs), F.lit(0)) / n,
    ]


def labelled_findings(spark: SparkSession, rows: int = 6000, first: int = 0) -> DataFrame:
    """(before, word, secret): findings made by rule from the numbers from ``first`` on, half of them false; a caller may bring a table of reviewed ones."""
    h = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), F.col("id")), 256)
    b64 = lambda salt: F.base64(F.unhex(h(salt)))
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    cut = lambda c, lo, hi, salt: F.substring(c, F.lit(1), (F.lit(lo) + F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(hi - lo + 1))).cast("int"))
    words = ["about", "report", "image", "profile", "summary", "section", "template", "window", "project", "release", "archive", "library"]
    w = lambda salt: pick(salt, words)
    quote = lambda c: F.when(F.col("id") % 3 == 0, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    names = ["token =", "api_key =", "password:", "secret =", "auth token:", "access key =", "the password is", "bearer", "client secret:", "my private key:"]
    plain = ["see the", "in the", "commit", "checksum sha256", "at version", "request id", "uuid:", "file", "build =", "the trace id:", "order number", "and the", "sample hash ="]
    yes = [
        (pick("n", names), quote(cut(h("a"), 32, 64, "l"))),
        (pick("n", names), quote(cut(b64("a"), 20, 43, "l"))),
        (pick("n", names), quote(F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(b64("b"), "[^A-Za-z0-9]", ""), 1, 16))))),
        (F.concat(w("v"), F.lit(" "), w("u")), F.concat(pick("m", ["token=", "api_key=", "password=", "secret:"]), cut(b64("c"), 20, 40, "l"))),
        (pick("n", names), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64("d"), "[^A-Za-z0-9]", "x"), 1, 36))),
        (pick("n", names), quote(F.substring(F.regexp_replace(b64("f"), "[^A-Za-z]", ""), 1, 24))),
        (pick("n", names), quote(F.concat(w("s"), F.substring(F.regexp_replace(h("g"), "[^0-9]", ""), 1, 2)))),
        (pick("n", names), quote(F.concat(F.initcap(F.regexp_replace(w("s"), "[aeio]", "0")), pick("t", ["!", "&", "#", "$", "%", "-", "_", ""]), F.substring(h("i"), 1, 4)))),
        (pick("n", names), quote(cut(b64("j"), 8, 14, "l"))),
        (F.lit(""), F.concat(pick("k", ["password=", "secret=", "pwd=", "passwd:", "token="]), cut(b64("o"), 7, 13, "l"))),
    ]
    no = [
        (pick("p", plain), quote(cut(h("a"), 32, 64, "l"))),
        (pick("p", plain), F.concat_ws("-", F.substring(h("e"), 1, 8), F.substring(h("e"), 9, 4), F.substring(h("e"), 13, 4), F.substring(h("e"), 17, 4), F.substring(h("e"), 21, 12))),
        (pick("q", plain + names), F.concat(F.lit("https://www."), w("a"), F.lit(".example/"), w("b"), F.lit("/"), w("c"), F.lit("-"), F.col("id"))),
        (pick("q", plain + names), F.concat(F.lit("/usr/"), w("a"), F.lit("/"), w("b"), F.lit("/"), w("c"), F.col("id"), F.lit(".txt"))),
        (pick("q", plain + names), F.concat(w("a"), F.lit("_"), w("b"), F.lit("_"), w("c"), F.lit("_"), F.col("id") % 97)),
        (pick("q", plain + names), F.concat(F.lit("20"), F.lpad((F.col("id") % 30).cast("string"), 2, "0"), F.lit("-01-15T10:30:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit(".000"))),
        (pick("q", plain + names), F.concat(F.initcap(w("a")), F.initcap(w("b")), F.initcap(w("c")))),
        (pick("q", plain + names), F.concat(w("a"), F.initcap(w("b")), F.initcap(w("c")), F.initcap(w("d")))),
        (pick("q", plain + names), F.concat(F.lit("https://en."), w("a"), F.lit(".example/wiki/"), F.initcap(w("b")), F.lit("_"), F.initcap(w("c")))),
        (pick("p", plain), F.substring(F.regexp_replace(b64("f"), "[^A-Za-z]", ""), 1, 24)),
        (pick("n", names), pick("r", ["required", "protected", "incorrect", "missing", "optional", "changed", "string", "<password>", "${PASSWORD}", "{{token}}", "********", "******", "function", "undefined", "example", "expired,", "another", "whether", "between", "invalid.", "required.", "cannot", "should", "always"])),
        (pick("n", names), w("z")),
        (F.lit(""), F.concat(pick("k", ["password=", "secret=", "pwd=", "passwd:", "token="]), w("z"))),
        (pick("q", plain + names), pick("x", ["xxxxxxxxxxxxxxxx0000", "0123456789abcdef0123", "aaaaaaaaaaaaaaaa1111", "changeme-changeme-1", "1111111111111111", "00000000000000000000000000000000"])),
    ]

    def arm(xs, key):
        return reduce(lambda acc, ix: acc.when(F.pmod(F.xxhash64(F.lit(key), "id"), F.lit(len(xs))) == ix[0], F.struct(ix[1][0].alias("before"), ix[1][1].alias("word"))), enumerate(xs), F).otherwise(F.struct(F.lit("").alias("before"), F.lit("").alias("word")))

    x = F.when(F.col("id") % 2 == 0, arm(yes, "y")).otherwise(arm(no, "z"))
    return spark.range(first, first + rows).select(x.alias("x"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("secret")).select("x.before", "x.word", "secret")


def fit(findings: DataFrame) -> str:
    """The forest (its description) from findings (before, word, secret); null and repeated ones count as they come."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    f = features(F.col("_f.secret"), F.col("_f.word"), F.col("_f.before"))
    found = findings.where("word is not null and secret is not null").withColumn("before", F.coalesce("before", F.lit("")))
    found = found.withColumn("_w", F.filter(F.split(F.concat_ws(" ", "before", "word"), "[\\x20\\x09-\\x0D]+"), lambda w: F.length(w) > 0))
    found = found.withColumn("_p", parts_of(F.col("word"), F.col("before")))
    values = F.concat(runs(F.col("_p")), announced(F.col("_w"), F.size("_w"), F.col("before")))
    found = found.withColumn("_f", F.coalesce(F.try_element_at(values, F.lit(-1)), F.struct(F.col("word").alias("secret"), F.col("word"), F.col("before"))))
    data = found.select(array_to_vector(F.array(*[x.cast("double") for x in f])).alias("features"), F.col("secret").cast("double").alias("label")).repartition(2)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, featureSubsetStrategy="sqrt").fit(data).toDebugString


def votes(forest: str, x: Column) -> Column:
    """The share of trees that vote for a secret, as an expression over the feature array x."""

    def tree(lines: list[str]) -> Column:
        line = lines.pop(0).strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        m = re.fullmatch(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line)
        yes = tree(lines)
        lines.pop(0)  # Else
        return F.when(x[int(m[1])] <= float(m[2]), yes).otherwise(tree(lines))

    trees = re.split(r"\n\s*Tree \d+ \(weight [\d.]+\):\n", forest)[1:]
    return reduce(lambda a, b: a + b, (tree(t.splitlines()) for t in trees)) / len(trees)


def scan(docs: DataFrame, forest: str) -> DataFrame:
    """docs with findings array<struct<secret,before,votes>> (every candidate) and masked, the text with its secrets replaced.

    Candidates are long runs with a digit or both cases, and values of
    LEAST_ANNOUNCED characters or more that a name announces.  A secret is replaced
    wherever the text has it, one shorter than LEAST only where it stands alone.  A
    null or empty text has no findings and stays as it is; repeated rows are all
    scanned; an empty table gives no rows; other columns pass through (one called
    findings or masked is replaced).
    """
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: F.length(w) > 0)
    kept = [c for c in docs.columns if c.lower() not in ("findings", "masked", "_w", "_at", "_near")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], words.alias("_w"))
    rows = rows.withColumn("_at", F.filter(F.transform("_w", lambda w, i: F.when(is_candidate(w), i + 1)), lambda i: i.isNotNull()))
    names = F.filter(F.transform("_w", lambda w, i: F.when(w.rlike(ANNOUNCE), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("_near", F.filter(F.array_distinct(F.flatten(F.transform(names, lambda i: F.array(i, i + 1, i + 2)))), lambda i: i <= F.size("_w")))

    def before(i):
        first = F.greatest(i - 3, F.lit(1))
        return F.array_join(F.slice("_w", first, i - first), " ")

    long = F.filter(F.flatten(F.transform("_p", runs)), lambda f: F.length(f["secret"]) >= LEAST)
    short = F.flatten(F.transform("_near", lambda i: announced(F.col("_w"), i, before(i))))
    scored = F.transform("_x", lambda f: F.struct(f["secret"].alias("secret"), f["before"].alias("before"), F.array(*[x.cast("double") for x in features(f["secret"], f["word"], f["before"])]).alias("x")))
    judged = F.transform("_y", lambda f: F.struct(f["secret"].alias("secret"), f["before"].alias("before"), votes(forest, f["x"]).alias("votes")))
    rows = rows.withColumn("_p", F.transform("_at", lambda i: parts_of(F.element_at("_w", i), before(i)))).withColumn("_x", F.concat(long, short)).withColumn("_y", scored).withColumn("findings", judged)
    secrets = F.array_sort(F.array_distinct(F.transform(F.filter("findings", lambda f: f["votes"] > VOTES), lambda f: f["secret"])), lambda a, b: F.length(b) - F.length(a))
    alone = lambda s: F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), s, F.lit("\\E(?![A-Za-z0-9])"))
    masked = F.aggregate(secrets, F.col("text"), lambda t, s: F.when(F.length(s) >= LEAST, F.replace(t, s, F.lit(MASK))).otherwise(F.regexp_replace(t, alone(s), F.lit(MASK))))
    return rows.withColumn("masked", masked).select(*[F.col(f"`{c}`") for c in kept], "findings", "masked")
