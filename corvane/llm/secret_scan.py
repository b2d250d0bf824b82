"""Secret scan: candidate strings are judged by a random forest, in DataFrame functions and Spark ML only.

A candidate is a run of at least 12 characters of ``[A-Za-z0-9+/_-]`` with a digit, or of at least 16 without. Its features
are length, shares of character classes, transitions between classes, share of common letter pairs, dictionary
coverage, path marks and the words around it. The forest is trained on labelled findings and then written out
as a column expression, so that scanning and redacting whole texts is one narrow pass without a shuffle.

Labelled findings may be given (``train``); ``weak_labels`` makes them from public formats and from assignments to
telling names, on at most ``train_docs`` documents of any kind and as many of all those where such a secret may stand
(each time those with the smallest hash of their id; the documented bound), and adds the fixed ``EXAMPLES``, which show
what the weak rule leaves open. So there are labels of both kinds at any size, and the forest always decides. A
candidate in a public key format needs no forest: its score is 1.

Null and empty texts have no candidates; texts of any length are scanned whole; repeated rows give repeated findings; empty tables give no rows; extra columns are kept
by ``redact`` and ignored by ``findings``. Positions are code points from 0.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed

# Nearly all words are shorter than 12 characters: they fail at the first look ahead, and nothing is tried again.
CANDIDATE = r"(?<![\w+/-])(?=[\w+/-]{12})(?:(?=[A-Za-z+/_-]{0,200}+[0-9])[\w+/-]++|[\w+/-]{16,}+)={0,2}"
# Words that tell a secret, and words that tell something else, before a candidate.
TELLING = r"(?i)(secret|passw|passwd|token|api.?key|access.?key|credential|bearer|private|auth)"
OTHER = r"(?i)(commit|sha|digest|checksum|uuid|order|phone|card|iban|isbn|version|hash|serial)"
ASSIGNED = r"(?i)(secret|passw(or)?d|token|key|credential|auth)[a-z_]*[\"']?\s*[:=]\s*[\"']?$"
# Public formats of keys.
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{20,})"
# Where a candidate may follow an assignment or be in a public format: no document that the weak rule finds a secret in lacks it.
MAYBE = "(" + ASSIGNED[:-1] + r"\s{0,2}[A-Za-z0-9+/_-]{12})|(?-i:" + FORMATS[1:] + ")"
# Every match of MAYBE holds one of these words in lower case, or one of these beginnings: looking for them takes less than the pattern.
MAYBE_WORDS, MAYBE_STARTS = ("secret", "passw", "token", "key", "credential", "auth"), ("AKIA", *(f"gh{x}_" for x in "pousr"), "sk-", "xox", "AIza", "eyJ")
# Frequent letter pairs of European languages.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie un ge sc ue qu el la os ad au".split()
# Common words of names, paths and prose.
DICTIONARY = "the and for with from this that are was not you all have new more any can our page home user users data file files name names type test tests example sample demo config public static index main path docs image images default value values class error info content site local server client version update list item items view search login admin report summary chapter section table figure license und der die das ist nicht mit von den ein eine les des est une pour dans que los las una por para con".split()

FEATURES = ["length", "digits", "uppers", "lowers", "turns", "pairs", "kinds", "words", "slashes", "joins", "hexed", "telling", "assigned", "quoted", "pathed", "other", "dotted"]

# Texts around a secret, and texts around something else by its kind.
SECRET_TEXTS = ["password={}", "passwd: {}", "the password is {} and", "my secret is {}.", "Authorization: Bearer {}", "bearer {}", "send bearer {} with it", "api key {}", "token = \"{}\"", "the token '{}'", "access_key: {}", "credentials {} for it", "private key {}", "client_secret={}", "auth {}", "\"apiKey\": \"{}\""]
OTHER_TEXTS = {
    "hex": ["commit {}", "sha256 {}", "digest {} of it", "checksum: {}", "hash={}", "see {} there"],
    "number": ["order {}", "card {}", "phone {}", "serial {}", "isbn {}", "about {} of them"],
    "word": ["the {} of it", "{}", "password {}", "the secret {} is known", "token {}", "key: {}", "a {} and"],
    "path": ["see /usr/share/{}", "https://{}", "in ./{} there", "password reset at /{}", "token file ~/{}", "open {}"],
}


def _examples() -> list[tuple[str, float]]:
    """The fixed labelled findings: (text with one candidate, 1 for a secret or 0)."""
    hexed = lambda *k: hashlib.sha512(repr(k).encode()).hexdigest()
    mixed = lambda *k: b64encode(hashlib.sha512(repr(k).encode()).digest()).decode().rstrip("=")
    rows = [(t.format(v), 1.0) for i, t in enumerate(SECRET_TEXTS) for v in (hexed(i)[:18], hexed(i)[:32], hexed(i)[:40], hexed(i)[:64], mixed(i)[:20], mixed(i)[:32], mixed(i)[:40])]
    w = [x for x in DICTIONARY if len(x) > 2]
    values = {
        "hex": lambda i: [hexed("o", i)[:n] for n in (32, 40, 64)],
        "number": lambda i: [str(int(hexed("n", i), 16))[:n] for n in (13, 16, 20)],
        "word": lambda i: ["".join(w[(7 * i + k) % len(w)] for k in range(8)), "_".join(w[(11 * i + k) % len(w)] for k in range(6)), "abcdefgh"[i % 8] * (20 + 30 * i)],
        "path": lambda i: ["/".join(w[(5 * i + k) % len(w)] for k in range(6)), "-".join(w[(3 * i + k) % len(w)] for k in range(6)) + f"-{2000 + i}"],
    }
    return rows + [(t.format(v), 0.0) for kind, ts in OTHER_TEXTS.items() for i, t in enumerate(ts) for v in values[kind](i)]


EXAMPLES = _examples()


def _share(pattern: str, text: Column, size: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / size


def _features(c: Column, before: Column, after: Column) -> dict[str, Column]:
    size = F.greatest(F.char_length(c), F.lit(1)).cast("double")
    low = F.lower(c)
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda w: F.array_contains(F.lit(DICTIONARY), w))
    flag = lambda x: x.cast("double")
    return {
        "length": size,
        "digits": _share("[0-9]", c, size),
        "uppers": _share("[A-Z]", c, size),
        "lowers": _share("[a-z]", c, size),
        "turns": _share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])", c, size),
        "pairs": _share("(?=" + "|".join(PAIRS) + ")", low, size),
        "kinds": F.size(F.array_distinct(F.split(c, ""))) / size,
        "words": F.aggregate(words, F.lit(0), lambda n, w: n + F.char_length(w)) / size,
        "slashes": _share("/", c, size),
        "joins": _share("[_-]", c, size),
        "hexed": flag(F.regexp_like(c, F.lit("^([0-9a-f]+|[0-9A-F]+)$"))),
        "telling": flag(F.regexp_like(before, F.lit(TELLING))),
        "assigned": flag(F.regexp_like(before, F.lit(r"[:=]\s*[\"']?$"))),
        "quoted": flag(F.regexp_like(before, F.lit("[\"'`]$"))),
        "pathed": flag(F.regexp_like(before, F.lit(r"([/\\.~:]|www)$"))),
        "other": flag(F.regexp_like(before, F.lit(OTHER))),
        "dotted": flag(F.regexp_like(after, F.lit(r"^[.:@/\\][A-Za-z0-9]"))),
    }


def _weak(c: Column, before: Column) -> Column:
    """1 secret, 0 none, null unknown."""
    mixed = F.regexp_like(c, F.lit("[0-9]")) & F.regexp_like(c, F.lit("[A-Za-z]"))
    secret = F.regexp_like(c, F.lit(FORMATS)) | (F.regexp_like(before, F.lit(ASSIGNED)) & mixed)
    return F.when(secret, 1.0).when(~F.regexp_like(before, F.lit(TELLING)), 0.0)


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add __gaps (the texts between) and __found (the candidates with features and weak label)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("__c", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    df = df.withColumn("__gaps", F.when(F.size("__c") > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)))  # few texts have candidates

    def one(c: Column, i: Column) -> Column:
        return F.struct(c.alias("c"), F.right(F.get("__gaps", i), F.lit(32)).alias("before"), F.left(F.get("__gaps", i + 1), F.lit(8)).alias("after"))

    df = df.withColumn("__c", F.transform("__c", one))
    judged = lambda x: F.struct(x["c"].alias("c"), *(v.alias(k) for k, v in _features(x["c"], x["before"], x["after"]).items()), _weak(x["c"], x["before"]).alias("weak"))
    return df.withColumn("__found", F.transform("__c", judged)).drop("__c")


def examples(spark: SparkSession) -> DataFrame:
    """The fixed labelled findings as literals, so that no Python worker makes them."""
    rows = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(y).alias("label")) for t, y in EXAMPLES))
    return spark.range(0, 1, 1, 1).select(F.explode(rows).alias("x")).select("x.*")


def maybe(text: Column) -> Column:
    """Whether MAYBE is found in a text."""
    low = F.lower(text)
    held = reduce(or_, [*(F.contains(low, F.lit(x)) for x in MAYBE_WORDS), *(F.contains(text, F.lit(x)) for x in MAYBE_STARTS)])
    return held & F.regexp_like(text, F.lit(MAYBE))


def weak_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = 20_000) -> DataFrame:
    """Features and label of the candidates where the weak rule knows, of at most ``train_docs`` documents and of as many of those
    that ``MAYBE`` finds among all, and of the fixed examples."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    first = lambda df: df.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(train_docs)
    ids = first(rows).unionByName(first(rows.filter(maybe(F.col("text"))))).distinct()
    some = rows.join(F.broadcast(ids), "id", "left_semi")  # 2 * train_docs ids at most
    # outer: of a plain explode Spark infers a filter on the candidates, which it moves below the join, so that they are made for the whole table
    found = with_candidates(some).select(F.explode_outer("__found").alias("f")).filter("f.weak IS NOT NULL").select("f.*", F.col("f.weak").alias("label"))
    given = with_candidates(examples(docs.sparkSession)).select("label", F.explode("__found").alias("f")).select("f.*", "label")
    return found.select(*FEATURES, "label").unionByName(given.select(*FEATURES, "label"))


def fit(labelled: DataFrame, trees: int = 12, depth: int = 5, seed: int = 7):
    """The random forest of labelled features. Both kinds of labels, which must be there, weigh the same in all."""
    # labels of a bounded number of documents, in an order that a second run meets again
    rows = checkpointed(labelled.select(*FEATURES, "label").repartition(8, *FEATURES).sortWithinPartitions(*FEATURES, "label"))
    kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not {0.0, 1.0} <= set(kinds):
        raise ValueError("labelled findings of both kinds are needed")
    weight = F.when(F.col("label") == 1, sum(kinds.values()) / kinds[1.0]).otherwise(sum(kinds.values()) / kinds[0.0])
    vectors = as_vectors(rows.withColumn("weight", weight))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", weightCol="weight").fit(vectors)


def as_vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def as_column(forest) -> Callable[[Column], Column]:
    """A function from a candidate's struct of features to the column of its score (0 to 1): the trees' mean share of secrets."""
    roots = [_read(t._java_obj.rootNode()) for t in forest.trees]
    return lambda f: sum((_tree(r, f) for r in roots[1:]), _tree(roots[0], f)) / float(len(roots))


def train(labelled: DataFrame, **options) -> Callable[[Column], Column]:
    return as_column(fit(labelled, **options))


def _read(node):
    """A tree as nested tuples (feature, threshold, left, right), a leaf as the share of secrets."""
    if node.getClass().getSimpleName() == "LeafNode":
        no, yes = list(node.impurityStats().stats())
        return yes / (no + yes)
    return FEATURES[node.split().featureIndex()], node.split().threshold(), _read(node.leftChild()), _read(node.rightChild())


def _tree(node, f: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    name, threshold, left, right = node
    return F.when(f[name] <= threshold, _tree(left, f)).otherwise(_tree(right, f))


def _scored(docs: DataFrame, score: Callable[[Column], Column], text_col: str) -> DataFrame:
    df = with_candidates(docs, text_col)
    judged = lambda f: F.when(F.regexp_like(f["c"], F.lit(FORMATS)), 1.0).otherwise(score(f))
    return df.withColumn("__found", F.transform("__found", lambda f: F.struct(f["c"].alias("c"), judged(f).alias("score"))))


def with_starts(df: DataFrame, block: int = 256) -> DataFrame:
    """Add __starts: where each candidate begins. Lengths are summed in blocks, and only within a block for each candidate."""
    both = F.transform("__found", lambda f, i: F.char_length(F.get("__gaps", i)) + F.char_length(f["c"]))
    df = df.withColumn("__steps", both)
    blocks = lambda n: F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / block), F.lit(0)).cast("int"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x)
    df = df.withColumn("__sums", F.transform(blocks(F.size("__steps")), lambda b: total(F.slice("__steps", b * block + 1, F.lit(block)))))
    df = df.withColumn("__before", F.transform(blocks(F.size("__steps")), lambda b: total(F.slice("__sums", F.lit(1), b))))
    within = lambda i: total(F.slice("__steps", i - i % block + 1, i % block))
    starts = F.transform("__found", lambda f, i: F.get("__before", F.floor(i / block).cast("int")) + within(i) + F.char_length(F.get("__gaps", i)))
    return df.withColumn("__starts", starts)


def findings(docs: DataFrame, score: Callable[[Column], Column], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per secret found: doc_id, start, end, score, secret_sha256, shown (its first four characters)."""
    df = with_starts(_scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), score, "text"))
    own = F.transform("__found", lambda f, i: F.struct(F.get("__starts", i).alias("start"), f["score"].alias("score"), f["c"].alias("c")))
    df = df.select("doc_id", F.explode(F.filter(own, lambda x: x["score"] >= threshold)).alias("f"))
    secret = F.col("f.c")
    return df.select("doc_id", F.col("f.start").alias("start"), (F.col("f.start") + F.char_length(secret)).alias("end"), F.col("f.score").alias("score"), F.sha2(secret, 256).alias("secret_sha256"), F.left(secret, F.lit(4)).alias("shown"))


def redact(docs: DataFrame, score: Callable[[Column], Column], threshold: float = 0.5, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All columns and rows, each secret in the text replaced by a mark; null texts stay null. Columns may have any names."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    pieces = F.transform("__found", lambda f, i: F.concat(F.when(f["score"] >= threshold, mark).otherwise(f["c"]), F.get("__gaps", i + 1)))
    clean = F.concat(F.get("__gaps", F.lit(0)), F.array_join(pieces, ""))
    df = _scored(whole, score, "text").withColumn("clean", F.when(F.col("text").isNotNull(), clean))
    return df.select(*((F.col("clean") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
