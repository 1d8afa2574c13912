"""Secret scan with a random forest against false positives (operator 6, DataFrame functions only).

A finding is a word of at least ``MIN_LENGTH`` characters with a digit, without
quotes and without a leading ``name=``; and every value behind a credential name,
short or without a digit as it may be (``password=x``, ``password: x``,
``password = x``; further assignment signs between them do not count as values).
Features: its length and classes of
characters, transitions between classes, coverage by dictionary words (the
alphabetic parts of it that are words of at least ``DICTIONARY_DOCS`` documents;
the dictionary is counted over the whole corpus), the path (words of the
source's name, and how many findings the source has per document) and the
neighbouring words. The forest is trained on labelled findings and scores all
of them; those below ``THRESHOLD`` are false positives.

Labels are given as a table, or, where none are, taken from formats that need no
judgement: access keys of known providers and values assigned to a credential
name are secrets; addresses, numbers, dates, hosts, versions and values that are
dictionary words as a whole are not. The rest
is unlabelled and judged by the forest alone; labelled findings are scored like
all others. Training draws at most about ``SAMPLE`` / 2 different values of each
label by hash, at a rate of its own (documented bound), so that the rarer label does
not thin out as the corpus grows; candidates, dictionary and scores cover
everything. A value trains with its first place (smallest id, then word index) and the
drawn values are sorted into one partition, so neither depends on the layout of the
input. If the drawn values do not hold both labels, a finding's label decides.

Null and empty texts have no findings. A null source is a path without words.
Repeated rows are reported each. An empty table gives no rows.
"""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import cut, table

MIN_LENGTH = 12
DICTIONARY_DOCS = 5
SAMPLE = 20_000
THRESHOLD = 0.5
TREES, DEPTH, SEED = 30, 8, 17

# Names that go before a credential, words of paths, formats with a known meaning.
CREDENTIAL = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)"
PATHS = r"(?i)(env|conf|config|key|secret|deploy|prod|src|code|repo)"
PROVIDER = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{24,})$"
HARMLESS = (r"^([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9 ().,:/+-]+|([0-9]{1,3}\.){3}[0-9]{1,3}|(https?://|www\.)\S+|"
            r"v?[0-9]+(\.[0-9]+)+|[0-9]{4}-[0-9]{2}-[0-9]{2}\S*)$")
NAME_END = CREDENTIAL + r"[\"'\])]*"                         # a credential name as the end of a word
LONG_WORD = rf"(?=\S*[0-9])\S{{{MIN_LENGTH},}}"
ASSIGNED = NAME_END + r"\s*(=|:|:=|=>)\s*[^\s=:>]"            # anywhere in a text: a name, a sign, a value
CANDIDATE = rf"(?:^|\s){LONG_WORD}|{ASSIGNED}"
IN_WORD = r"^[^=:]*" + NAME_END + r"(=|:|:=|=>)[^\s=:>]"        # password=x
NAMED_SIGN, SIGN = NAME_END + "(=|:|:=|=>)$", r"^(=|:|:=|=>)$"   # "password: x", and "password = x" in three words
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9"}


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, path, word_index, name (before an equals sign), value, before (two words), after."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("body"))
    words = given.where(F.col("body").rlike(CANDIDATE)).withColumn("words", F.split("body", r"\s+"))
    word = lambda i, by: F.coalesce(F.when(i + F.lit(by) >= 0, F.get(F.col("words"), i + F.lit(by))), F.lit(""))
    behind = lambda i: ~word(i, 0).rlike(SIGN) & (
        word(i, -1).rlike(NAMED_SIGN) | (word(i, -1).rlike(SIGN) & word(i, -2).rlike(NAME_END + "$")))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1),
                  lambda i: word(i, 0).rlike(rf"^{LONG_WORD}$") | word(i, 0).rlike(IN_WORD) | (behind(i) & (word(i, 0) != "")))
    found = words.select("id", "path", F.explode(F.transform(at, lambda i: F.struct(
        i.alias("word_index"), word(i, 0).alias("word"), word(i, -2).alias("b2"), word(i, -1).alias("b1"), word(i, 1).alias("after")))).alias("f")).select("id", "path", "f.*")
    bare = F.regexp_replace("word", r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$", "")
    named = F.regexp_extract(bare, r"^([A-Za-z_][A-Za-z0-9_.-]*)[=:][\"']?\S+$", 1)
    value = F.when(named != "", F.regexp_extract(bare, r"^[A-Za-z_][A-Za-z0-9_.-]*[=:][\"']?(\S+)$", 1)).otherwise(bare)
    return found.select("id", "path", "word_index", named.alias("name"), value.alias("value"), F.concat_ws(" ", "b2", "b1").alias("before"), "after")


def dictionary(docs: DataFrame, text_col: str = "text", min_docs: int = DICTIONARY_DOCS) -> DataFrame:
    """word: lower-case a-z words of at least three letters in at least ``min_docs`` documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(?<![a-z])[a-z]{3,}(?![a-z])"), F.lit(0)))
    return (docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
            .where(F.col("docs") >= min_docs).select("word"))


def weak_label() -> Column:
    """1 secret, 0 harmless, null unknown (of rows with the columns of :func:`features`)."""
    value = F.col("value")
    assigned = F.col("name").rlike(CREDENTIAL) | F.regexp_replace("before", r"[\s\"'=:]+$", "").rlike(CREDENTIAL + "$")
    return (F.when(value.rlike(HARMLESS) | (value.rlike("^[A-Za-z]+$") & (F.col("f_dictionary") == 1.0)), 0.0).when(value.rlike(PROVIDER), 1.0)
            .when(assigned & value.rlike(r"^[A-Za-z0-9+/_=-]{12,}$"), 1.0).otherwise(F.lit(None).cast("double")))


def features(found: DataFrame, docs: DataFrame, words: DataFrame, path_col: str = "source") -> tuple[DataFrame, list[str]]:
    """``found`` with the forest's columns, and their names."""
    value, size = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    found = found.where(F.length("value") > 0).withColumn("f_length", size)
    names = ["f_length"]
    for name, chars in {**CLASSES, "other": "^a-zA-Z0-9"}.items():
        found = found.withColumn(f"f_{name}", F.regexp_count(value, F.lit(f"[{chars}]")) / size)
        names.append(f"f_{name}")
    for a, x in CLASSES.items():
        for b, y in CLASSES.items():
            found = found.withColumn(f"f_{a}_{b}", F.regexp_count(value, F.lit(f"[{x}](?=[{y}])")) / size)
            names.append(f"f_{a}_{b}")
    found = found.withColumn("f_distinct", F.size(F.array_distinct(F.split(value, ""))) / size)
    parts = (found.select("value").distinct().withColumn("part", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0)))))
    covered = (parts.join(words, parts.part == words.word).groupBy("value").agg(F.sum(F.length("part")).alias("covered"))
               .withColumnRenamed("value", "of_value"))
    found = found.join(covered, value == F.col("of_value"), "left").withColumn("f_dictionary", F.coalesce("covered", F.lit(0)) / size)
    per_path = docs.groupBy(F.col(path_col).cast("string").alias("of_path")).agg(F.count(F.lit(1)).alias("docs"))
    hits = found.groupBy(F.col("path").alias("hit_path")).agg(F.count(F.lit(1)).alias("hits"))
    density = per_path.join(hits, F.col("of_path").eqNullSafe(F.col("hit_path"))).select("of_path", (F.col("hits") / F.col("docs")).alias("f_path_density"))
    found = found.join(density, F.col("path").eqNullSafe(F.col("of_path")), "left")
    path = F.coalesce("path", F.lit(""))
    more = {"f_path_words": path.rlike(PATHS).cast("double"), "f_path_test": path.rlike("(?i)(test|example|sample|doc|demo)").cast("double"),
            "f_named": (F.col("name") != "").cast("double"), "f_name_credential": F.col("name").rlike(CREDENTIAL).cast("double"),
            "f_before_credential": F.col("before").rlike(CREDENTIAL).cast("double"), "f_before_assigns": F.col("before").rlike(r"[=:][\"']?$").cast("double"),
            "f_before_length": F.length("before").cast("double"), "f_after_length": F.length("after").cast("double"),
            "f_after_word": F.lower("after").rlike("^[a-z]+[.,]?$").cast("double")}
    for name, column in more.items():
        found = found.withColumn(name, column)
    found = found.withColumn("f_path_density", F.coalesce("f_path_density", F.lit(0.0)))
    return found.drop("covered", "of_value", "of_path"), [*names, "f_distinct", "f_dictionary", "f_path_density", *more]


def scan(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, word_index, name, value, label, probability, secret of every finding.

    ``labels`` (value, label 0/1) replaces the labels taken from formats.
    """
    found, names = features(findings(docs, id_col, text_col, path_col), docs, dictionary(docs, text_col), path_col)
    if labels is None:
        found = found.withColumn("label", weak_label())
    else:
        given = labels.select(F.col("value").alias("of_value"), F.col("label").cast("double").alias("label")).dropDuplicates(["of_value"])
        found = found.join(given, F.col("value") == F.col("of_value"), "left").drop("of_value")
    found = cut(found, "findings")
    place = F.struct("id", "word_index", *names)
    known = (found.where("label is not null").groupBy("value").agg(F.min_by(F.struct(*names, "label"), place).alias("x"))
             .select("value", "x.*"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, min(1.0, SAMPLE / 2 / n)).otherwise(rate)
    drawn = known.where(F.pmod(F.xxhash64("value"), F.lit(1 << 40)) < rate * F.lit(float(1 << 40)))
    drawn = cut(drawn.repartition(1), "labelled", "value")      # about SAMPLE rows at most, whatever the corpus
    if drawn.select("label").distinct().count() < 2:
        scored = found.withColumn("probability", F.coalesce("label", F.lit(0.0)))
    else:
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", probabilityCol="both", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest]).fit(drawn)
        scored = model.transform(found).withColumn("probability", F.get(vector_to_array("both"), F.lit(1)))
    return scored.select(F.col("id").alias("doc_id"), "word_index", "name", "value", "label", "probability",
                         (F.col("probability") >= THRESHOLD).alias("secret"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
