"""Secret scan: candidate strings, and a random forest that removes the false positives.

Candidates are long runs of key characters that mix letters and digits, very long runs, and whatever
is assigned to a name like token, secret, password or key. Every run of a word is looked at, so one
word (compact JSON, a URL, `user=..;password=..`) may give several; a run keeps its base64 padding,
and dots join its segments (JWT). The forest sees a candidate's length, its
character transitions, how much of it dictionary words cover, its path and its neighbouring words,
and is trained on labelled findings: columns before, candidate, after, path, label.

The given tables hold no labelled findings, so `examples` makes them out of documents: digests in
assignments, padded base64, JWT, values in JSON, URLs and backticks are true, and words, placeholders, checksums under their names, numbers and repeated
characters are false. Any other labelled table with these columns does as well.

All of it is DataFrame and SQL functions; the forest is Spark's own.

Rows: one per candidate, in any order. Null and empty texts have none. A candidate that occurs twice
in a document is two findings; repeated rows repeat their findings. Extra columns are left out. An
empty table gives an empty result. Secrets are shown as digests only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breadthline.llm.common import split_of
from breadthline.session import land

NAMES = "token|secret|passw|passwd|pwd|api_?-?key|access_?-?key|private_?-?key|credential|auth"
RUN = "[A-Za-z0-9+/_=-]"
KEY = "[A-Za-z0-9+/_-]"
QUOTE = "[\"'`]"
#: What stands before a run, and the run. Equals signs at its end are padding unless a value follows.
#: A dot joins segments of a JWT, and of other runs if they are long. Repeats are bounded because
#: Java matches them recursively; what is left over is the next run.
EACH_RUN = (f"(?s)\\G(.*?)((?:eyJ[A-Za-z0-9_-]{{5,}}(?:\\.{{1,2}}[A-Za-z0-9_-]+){{1,4}}"
            f"|{KEY}{{8,}}(?:\\.{KEY}{{8,}}){{0,8}})(?:={{1,2}}(?!{QUOTE}?{RUN}))?)")
#: A name with the sign that assigns to it, at the end of what stands before a run.
NAMED = f"(?i)({NAMES})[^\\s,;&?{{}}]*\\s*[=:]>?\\s*\\\\?{QUOTE}?$"
#: Documents worth splitting into words: a long run with a digit, a very long run, or a name.
WORTH = f"(?=[A-Za-z0-9+/_-]{{16}})[A-Za-z+/_-]*[0-9]|{RUN}{{32}}|(?i:{NAMES})"

# Words that mark text rather than keys, and pairs of letters frequent in prose.
WORDS = ("example|sample|dummy|changeme|change|placeholder|test|your|my|demo|none|null|true|false|"
         "token|secret|password|pass|key|user|name|admin|default|value|config|string|insert|here|"
         "todo|fake|mock|public|private|access|client|server|local|host|data|file|path|http|https|"
         "www|com|org|and|the|tion|that|with|have|this|from|they|which|ing|ent|able|ness|ment|heit|"
         "keit|lich|ung|sch|und|der|die|que|les|des|eau|eux|ción|mente|los|las|para|xxx|abc|123456")
PAIRS = ("th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|ed|is|it|al|ar|st|nt|to|ng|se|ha|as|ou|io|le|"
         "ve|co|me|ea|ou|ei|ch|ie|un|qu|ue|ai|os|la|do")
BENIGN = "commit|checksum|sha|md5|digest|hash|uuid|revision|card|phone|isbn|order|example|sample"
INPUTS = ("size", "digits", "upper", "lower", "signs", "switches", "pairs", "distinct", "hex",
          "covered", "named", "assigned", "quoted", "benign", "path_test", "path_config")


def features(findings: DataFrame) -> DataFrame:
    """The forest's inputs, as doubles, added to columns before, candidate, after, path."""
    c = F.col("candidate")
    size = F.greatest(F.length(c), F.lit(1)).cast("double")
    low = F.lower(c)

    def share(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / size

    def has(column: Column, pattern: str) -> Column:
        return F.coalesce(column, F.lit("")).rlike(pattern).cast("double")

    before, after = F.col("before"), F.col("after")
    near = F.concat_ws(" ", before, after)
    switch = ("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
              "|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    values = {
        "size": size,
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"), "switches": share(switch),
        "pairs": share(f"(?=({PAIRS}))", low),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "hex": has(c, "^[0-9a-fA-F]+$"),
        "covered": 1 - F.length(F.regexp_replace(low, WORDS, "")) / size,
        "named": has(before, f"(?i)({NAMES})"),
        "assigned": has(before, f"[=:]>?\\s*{QUOTE}?$"),
        "quoted": has(before, f"{QUOTE}$"),
        "benign": has(near, f"(?i)({BENIGN})"),
        "path_test": has(F.col("path"), "(?i)(test|example|sample|fixture|mock|docs?/)"),
        "path_config": has(F.col("path"), "(?i)(env|config|secret|\\.ya?ml|\\.ini|\\.pem|\\.key)"),
    }
    return findings.withColumns({k: v.cast("double") for k, v in values.items()})


def candidates(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """doc_id, place (number of the word, the same for all of its runs), before, candidate, after,
    path."""
    path = F.lit("") if path is None else path
    words = F.col("words")

    def near(i: Column) -> Column:
        """The word i with its neighbours; only such words leave their document's array."""
        def at(k: int) -> Column:
            return F.coalesce(F.get(words, i + k), F.lit(""))

        return F.struct(i.alias("place"), at(0).alias("word"), at(-2).alias("b0"),
                        at(-1).alias("b1"), at(1).alias("after"))

    likely = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).rlike(
        f"{RUN}{{32}}|(?=.*[0-9]){RUN}{{8}}") | F.get(words, i - 1).rlike(f"[=:]>?{QUOTE}?$")
        | F.get(words, i).rlike("[=:]"))
    words_found = (
        docs.where(F.col("text").rlike(WORTH))
        .select("doc_id", path.cast("string").alias("path"), F.split("text", "\\s+").alias("words"))
        .select("doc_id", "path", F.explode(F.transform(likely, near)).alias("w"))
        .select("doc_id", "path", "w.*")
    )
    gaps = F.regexp_extract_all("word", F.lit(EACH_RUN), F.lit(1))
    runs = F.regexp_extract_all("word", F.lit(EACH_RUN), F.lit(2))

    def found_at(run: Column, i: Column) -> Column:
        """A run with what stands before it inside its own word (an opening quote, `name=`)."""
        own = F.concat(F.coalesce(F.get("runs", i - 1), F.lit("")), F.get("gaps", i))
        return F.struct(F.right(own, F.lit(200)).alias("own"), run.alias("candidate"))

    found = (
        words_found.withColumns({"gaps": gaps, "runs": runs})
        .select("doc_id", "path", "place", "b0", "b1", "after",
                F.explode(F.transform("runs", found_at)).alias("r"))
        .select("doc_id", "path", "place", "b0", "b1", "after", "r.*")
    )
    # Behind a field's end the names of the fields before it say nothing about the run.
    field = F.regexp_replace("own", "(?s)^.*[,;&?{}]", "")
    found = found.withColumn("before", F.when(F.length(field) < F.length("own"), field).otherwise(
        F.concat_ws(" ", "b0", "b1", "own")))
    c = F.col("candidate")
    mixed = (F.length(c) >= 16) & c.rlike("[0-9]") & c.rlike("[A-Za-z]|^[0-9]+$")
    named = F.col("before").rlike(NAMED)
    return found.where(mixed | (F.length(c) >= 32) | ((F.length(c) >= 8) & named)).select(
        "doc_id", "place", "before", "candidate", "after", "path")


def lowest_hashes(docs: DataFrame, limit: int) -> DataFrame:
    """Rows to learn from whose id's hash is no higher than that of the row numbered `limit`.

    The bound is found on the hashes alone, so no texts of other rows are sorted or moved.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                        & (split_of(F.col("doc_id"), 5) != 0))
    hashed = F.xxhash64("doc_id")
    lowest = usable.select(hashed.alias("h")).orderBy("h").limit(limit)
    return usable.where(hashed <= lowest.agg(F.max("h")).scalar())


def examples(docs: DataFrame, limit: int = 2_000) -> DataFrame:
    """Labelled findings made of at most `limit` documents (lowest hash of the id first).

    Held-out documents (crc32 of the id modulo 5 is 0) give none.
    """
    some = (
        lowest_hashes(docs, limit)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        .select("doc_id", F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " +").alias("w"),
                F.sha1("text").alias("a"), F.sha2("text", 256).alias("b"),
                F.md5(F.concat("text", F.lit("x"))).alias("c"))
    )
    word = [F.coalesce(F.get("w", F.lit(i)), F.lit("word")) for i in range(6)]
    coded = F.base64(F.unhex("b"))
    plain = F.regexp_replace(coded, "[+/=]", "")
    jwt = F.concat_ws(".", F.lit("eyJhbGciOiJIUzI1NiJ9"), F.regexp_replace(F.base64(F.concat(
        F.lit('{"sub":"'), word[0], F.lit('"}'))), "[+/=]", ""), plain)

    def case(before, candidate: Column, after, path: str, label: int) -> Column:
        return F.struct(*[
            (x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in
            zip(("before", "candidate", "after", "path", "label"),
                (before, candidate, after, path, label))])

    made = F.array(
        case(F.concat(word[0], F.lit(" token = \"")), F.col("a"), word[1], "", 1),
        case(F.concat(word[0], F.lit(" api_key: ")), plain, word[1], "app/config.yml", 1),
        case("export SECRET_KEY=", F.col("c"), word[2], "", 1),
        case(F.concat(word[3], F.lit(" PASSWORD = '")), F.substring(plain, 3, 20), word[2], "", 1),
        case("TOKEN = \"", F.upper("a"), word[2], "", 1),
        case(F.concat(word[0], F.lit(" token = \"")), coded, word[1], "", 1),
        case(F.concat(F.lit("\"user\":\""), word[0], F.lit("\" \"api_key\":\"")), F.col("c"), word[1],
             "", 1),
        case("token=", F.substring(plain, 5, 24), word[1], "", 1),
        case("password=", F.substring(plain, 9, 12), word[2], "", 1),
        case(F.concat(word[1], F.lit(" secret: `")), F.substring(plain, 1, 32), word[2], "", 1),
        case(F.concat(word[1], F.lit(" Authorization: Bearer ")), jwt, word[2], "", 1),
        case("access_token=", jwt, word[2], "", 1),
        case(F.concat(F.lit("https://"), word[0], F.lit(".com")),
             F.concat(F.lit("/2024/"), F.concat_ws("/", *word[1:4])), word[4], "", 0),
        case(F.concat(F.lit("\"name\":\"")), F.concat_ws("-", *word[:4], F.lit("2024")), word[4], "", 0),
        case("token = \"", F.concat_ws(".", *word[:4]), word[4], "", 0),
        case("token = \"", F.concat_ws("_", *word[:4]), word[4], "", 0),
        case("secret_key = '", F.concat(F.lit("example-"), word[1], F.lit("-key-123456")),
             word[2], "", 0),
        case("password: ", F.concat(F.lit("changeme-"), word[0], F.lit("-"), word[1]), word[2],
             "docs/setup", 0),
        case(F.concat(F.lit("commit "), word[0]), F.col("a"), word[1], "", 0),
        case("sha256 checksum ", F.col("b"), word[3], "", 0),
        case(F.concat_ws(" ", word[0], word[1]),
             F.substring(F.regexp_replace("b", "[a-f]", "7"), 1, 16), word[2], "", 0),
        case("api_key = \"", F.rpad(F.lit(""), 32, "x"), word[2], "", 0),
        case("token = \"", F.lit("0000000000000000000000000000000000000000"), word[2], "", 0),
        case("secret: ", F.col("c"), word[2], "tests/fixtures/keys", 0),
        case(F.concat_ws(" ", word[4], word[5]), F.concat_ws("-", *word[:5]), word[0], "", 0),
        case(F.concat_ws(" ", word[4], word[5]),
             F.concat(word[0], word[1], word[2], word[3], F.lit("2024")), word[0], "", 0),
    )
    return some.select(F.inline(made)).where(F.length("candidate") >= 8)


def train(labelled: DataFrame, trees: int = 24, depth: int = 6) -> RandomForestClassificationModel:
    """A forest on labelled findings."""
    rows = VectorAssembler(inputCols=list(INPUTS), outputCol="inputs").transform(features(labelled))
    forest = RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=trees,
                                    maxDepth=depth, seed=7)
    return forest.fit(rows.select("inputs", F.col("label").cast("double")))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None,
         path: Column | None = None) -> DataFrame:
    """Candidates with score; without a model (nothing to learn from) every score is 0."""
    found = candidates(docs, path)
    if model is None:
        return found.withColumn("score", F.lit(0.0))
    rows = VectorAssembler(inputCols=list(INPUTS), outputCol="inputs").transform(features(found))
    return model.transform(rows).withColumn(
        "score", vector_to_array("probability")[1]).select(*found.columns, "score")


def trained_on(docs: DataFrame, limit: int = 2_000) -> RandomForestClassificationModel | None:
    # The forest reads its rows many times; one partition, as they came, keeps its draws the same.
    labelled = land(examples(docs, limit), "examples").coalesce(1)
    return None if labelled.isEmpty() else train(labelled)


def secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, place, length, candidate_sha256, named, score, is_secret: one row per candidate."""
    found = scan(docs, trained_on(docs))
    return found.select(
        "doc_id", "place", F.length("candidate").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        F.col("before").rlike(f"(?i)({NAMES})").alias("named"), "score",
        (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """A step of the corpus job: all rows, with the secrets in their texts replaced by a mark."""
    found = scan(docs, trained_on(docs)).where(F.col("score") >= threshold)
    # The longest first, so that a secret inside another leaves nothing behind.
    hidden = found.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_set(
        F.struct(F.length("candidate").alias("n"), "candidate")))).alias("_hidden"))
    rows = docs.join(hidden.withColumnRenamed("doc_id", "_id"),
                     docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    clean = F.aggregate(
        F.col("_hidden"), F.col("text"), lambda text, s: F.replace(text, s["candidate"], F.lit(mark)))
    text = F.when(F.col("_hidden").isNull(), F.col("text")).otherwise(clean)
    return rows.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
