"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 12 or more key characters with a digit in it. Its features are its
length, shares and transitions of character classes, common letter pairs, coverage by a small
dictionary, whether it is part of a path, whether a path stands before it and leads to tests or samples, and the
words before and after it. The forest is trained from labelled findings: by default `labelled_findings`,
4000 made-up ones of known kinds; `measure` tells precision and recall on findings held out. All of it
is DataFrame operations and Spark ML. Findings of one label only give that label as every score, and none give 0.

Null and empty texts have no candidates. Ids may be null or repeated: rows are scanned one by one.
Other columns are not read. An empty table gives an empty result. Texts are whole, of any
length.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"(?<![A-Za-z0-9+/_=.~-])(?=[A-Za-z+/_=.~-]*[0-9])[A-Za-z0-9+/_=.~-]{11,}[A-Za-z0-9+/_=-]"
# Words and letter pairs of readable names, and words beside findings.
DICTIONARY = "access account admin alpha api app auth backup beta build cache client code com config data db default demo dev dist docs domain email example file final foo gnu host html http id img index info init internal key lib linux local log mail main master model module name net node null object org package page password path port prod project public python query release report root sample script secret server service session site source src static string system table temp test text tmp token tool type url user usr util value var version web www".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st nt to io le ve co me de".split()
NEAR_SECRETS = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)"
NEAR_OTHERS = r"(?:sha\d*|commit|checksum|digest|uuid|guid|example|hash|md5|version|build|revision|etag|isbn|order|invoice|phone|card|account|ref)"
PATH = r"(?:^|[\s\"'(])[\w.-]*/[\w./-]+[:\s\"')]"
SAMPLE_PATH = r"(?:tests?|examples?|samples?|fixtures?|docs?|mocks?|vendor|node_modules)/[\w./-]*"
PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|sk_(?:live|test)_|rk_live_|xox[abprs]-|AIza|eyJ|glpat-|npm_|SG\.)"

FEATURES = ["size", "digits", "upper", "lower", "other", "distinct", "hexadecimal", "moves", "pairs", "covered", "in_path", "dots", "assigned", "quoted", "near_secret", "near_other", "prefixed", "after_at", "all_digits", "path_before", "sample_path", "other_after", "sentence_after"]


def candidates(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with one row for each candidate instead of the text: nth, value, before, after."""
    found = F.when(F.col(text_col).rlike("[0-9]"), F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    held = rows.withColumn("_found", found).where("size(_found) > 0").withColumn("_between", F.split(text_col, CANDIDATE, -1))
    around = F.transform("_found", lambda v, i: F.struct(v.alias("value"), F.right(F.element_at("_between", i + 1), F.lit(80)).alias("before"), F.left(F.element_at("_between", i + 2), F.lit(20)).alias("after")))
    return held.select(*[c for c in rows.columns if c != text_col], F.posexplode(around).alias("nth", "c")).select("*", "c.*").drop("c")


def features(found: DataFrame) -> DataFrame:
    v, before, after = F.col("value"), F.lower(F.col("before")), F.lower(F.col("after"))
    size = F.length(v)

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / size

    moves = F.regexp_count(v, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / size
    rest = F.length(F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    flag = lambda c: c.cast("double")
    return found.select(
        "*", size.cast("double").alias("size"), share("[0-9]").alias("digits"), share("[A-Z]").alias("upper"), share("[a-z]").alias("lower"), share("[^A-Za-z0-9]").alias("other"),
        (F.size(F.array_distinct(F.split(v, ""))) / size).alias("distinct"), flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hexadecimal"), moves.alias("moves"),
        (F.regexp_count(F.lower(v), F.lit("(?=" + "|".join(PAIRS) + ")")) / size).alias("pairs"), (1 - rest / size).alias("covered"), flag(v.rlike(r"/.*/|^/|\.[a-z]{1,4}$")).alias("in_path"), share(r"[.]").alias("dots"),
        flag(before.rlike(r"[=:]\s*[\"']?$") | v.contains("=")).alias("assigned"), flag(before.rlike("[\"']$")).alias("quoted"),
        flag(before.rlike(NEAR_SECRETS + r"[^a-z]*$") | F.lower(v).rlike("^" + NEAR_SECRETS + "=")).alias("near_secret"), flag(before.rlike(NEAR_OTHERS + r"[^a-z]*$")).alias("near_other"),
        flag(v.rlike(PREFIXES)).alias("prefixed"), flag(before.rlike("@$")).alias("after_at"), flag(v.rlike("^[0-9.+-]+$")).alias("all_digits"),
        flag(before.rlike(PATH)).alias("path_before"), flag(before.rlike(SAMPLE_PATH)).alias("sample_path"), flag(after.rlike(r"^[^a-z0-9]{0,3}\(?" + NEAR_OTHERS)).alias("other_after"), flag(after.rlike(r"^[.,;:!?]?\s+[a-z]{2,}\s")).alias("sentence_after"),
    )


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, label): n made-up findings in words, half of them secrets."""
    h = [F.sha2(F.concat(F.col("id").cast("string"), F.lit(s)), 256) for s in "abcd"]
    base64 = F.translate(F.base64(F.unhex(h[0])), "=", "A")
    upper = F.upper(F.translate(F.substring(h[1], 1, 16), "abcdef", "QXKVWZ"))
    words = F.array(*map(F.lit, "the of and from near under before version total status about where".split()))
    word = lambda k: F.element_at(words, F.pmod(F.conv(F.substring(h[2], 2 * k + 1, 2), 16, 10).cast("int"), F.lit(12)) + 1)
    name = F.element_at(F.array(*map(F.lit, "token secret password api_key access_key auth".split())), F.pmod(F.conv(F.substring(h[3], 1, 2), 16, 10).cast("int"), F.lit(6)) + 1)
    quote, c = F.lit('"'), F.concat
    digits = F.translate(h[1], "abcdef", "135790")
    secret = [
        c(name, F.lit(" = "), quote, F.substring(h[0], 1, 40), quote), c(name, F.lit("="), F.substring(h[0], 1, 18)), c(F.lit("AKIA"), upper), c(name, F.lit(': "'), F.substring(base64, 1, 32), quote),
        c(F.lit("ghp_"), F.substring(base64, 1, 36)), c(F.upper(name), F.lit(' = "'), F.upper(F.substring(h[0], 1, 40)), quote), c(name, F.lit("="), F.substring(base64, 1, 20)), c(F.lit("sk_live_"), F.substring(base64, 1, 24)),
    ]
    other = [
        c(F.lit("commit "), F.substring(h[0], 1, 40)), c(F.lit("sha256:"), h[0]), c(F.lit("uuid "), F.substring(h[0], 1, 8), F.lit("-"), F.substring(h[0], 9, 4), F.lit("-"), F.substring(h[0], 13, 4), F.lit("-"), F.substring(h[0], 17, 12)), F.substring(digits, 1, 16),
        c(word(5), F.lit("@mail"), F.substring(digits, 1, 1), F.lit(".example.com")), c(F.lit("/usr/lib/x86_64-linux-gnu/lib"), word(6), F.lit(".so."), F.substring(digits, 1, 1)), c(word(7), F.lit("-release-"), F.substring(digits, 1, 1), F.lit(".0."), F.substring(digits, 2, 2)), c(F.lit("order "), F.substring(digits, 1, 12)),
    ]
    kinds = secret + other
    pick = F.element_at(F.array(*kinds), F.pmod("id", F.lit(len(kinds))).cast("int") + 1)
    rows = spark.range(n).select(c(word(0), F.lit(" "), word(1), F.lit(" "), pick, F.lit(" "), word(2), F.lit(" "), word(3)).alias("text"), (F.pmod("id", F.lit(len(kinds))) < len(secret)).cast("double").alias("label"))
    return rows


def fit(labelled: DataFrame, text_col: str = "text", trees: int = 30, depth: int = 8, seed: int = 17) -> RandomForestClassificationModel | float:
    """labelled: texts with a `label` of 1 if their candidates are secrets and 0 if not. One label alone is returned as it is."""
    labelled = labelled.where("label in (0, 1)").withColumn("label", F.col("label").cast("double"))
    kinds = [r[0] for r in candidates(labelled.select(text_col, "label"), text_col).select("label").distinct().collect()]  # two at most
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(labelled.select(text_col, "label"), text_col)))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.select("features", "label"))


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, nth, value, score, is_secret) of every candidate; nth counts a text's candidates from 0."""
    model = fit(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = features(candidates(rows, "text"))
    if isinstance(model, float):
        scored, score = found, F.lit(model)
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
        score = F.element_at(vector_to_array("probability"), 2)
    return scored.select(F.col("id").alias(id_col), "nth", "value", score.alias("score"), (score >= threshold).alias("is_secret"))


def measure(labelled: DataFrame, held_out: DataFrame, threshold: float = 0.5) -> tuple[float, float]:
    """(precision, recall) on held-out findings of a forest trained on the others."""
    rows = held_out.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "text", "label")
    rows = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)  # a test's rows; ids must not change
    found = secret_scan(rows, labelled, threshold=threshold).join(rows.select("doc_id", "label"), "doc_id")
    hit, said, real = found.agg(F.count_if(F.col("is_secret") & (F.col("label") == 1)), F.count_if("is_secret"), F.count_if(F.col("label") == 1)).first()
    return hit / max(said, 1), hit / max(real, 1)
