"""Secret scan: candidates by shape, false positives removed by a random forest, in DataFrame functions only.

Candidates are words of at least ``LEAST`` characters, all of them characters of keys, that
hold a digit, begin like a known key, or are letters in an unlikely order; and whatever of
at least ``LEAST_NAMED`` characters follows a word like "password", with all its marks, up
to a space or, if quoted, to the closing quote. Each has its place among the words of the
text, that of its first word. Features: length; shares of
digits, letters and marks; how often character kinds change; how many characters differ;
how much of it words of a dictionary cover; what the path says; and what the two words
before and the one after say. The forest is trained by Spark's own library on labelled
findings, of which at most ``MAX_FINDINGS`` are used. Texts are scanned in one pass;
nothing is shuffled.

Defined results: null and empty texts have no candidates; words are taken wherever they
stand, in very long texts too; repeated candidates and rows are reported each; null paths
say nothing; an empty table gives no rows; further columns are ignored. Labelled findings
whose label or candidate is null are left out; without both labels training raises a
ValueError that says so.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, LEAST_NAMED, MAX_FINDINGS, THRESHOLD = 12, 6, 50_000, 0.5
SEPARATORS = "[\\s\"'`,;:=()<>\\[\\]{}|#&%$!?*]+"
SHAPE = "^[A-Za-z0-9_+/.@~-]*[0-9][A-Za-z0-9_+/.@~-]*$"
KEYS = "^[A-Za-z0-9_+/.@~-]*$"
PREFIX = "^(AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|AIza|eyJ)"
#: Letters in an order that words rarely have: many consonants in a row, or case that changes often.
UNLIKELY = "(?i:[bcdfghjklmnpqrstvwxz]{5})|([a-z]+[A-Z]+){3}"
#: Words of the neighbourhood, of paths, and of the dictionary.
NAMES = "token|secret|password|passwd|pwd|key|apikey|api_key|auth|bearer|credential|private|access"
DIGESTS = "sha|sha1|sha256|md5|commit|digest|checksum|hash|revision|rev|etag|integrity|uuid|guid|id"
HARMLESS_PATHS = "test|example|fixture|sample|doc|lock|vendor|min\\.js|\\.md$"
RISKY_PATHS = "env|config|secret|credential|\\.ya?ml$|\\.tf$|settings"
DICTIONARY = "example|domain|version|release|build|image|photo|report|chapter|section|index|data|file|mail|info|user|admin|server|client|test|page|line|table|figure|item|order|phone|the|and|with|com|net|org|www|http|html|json|png|jpg"
#: The empty place where what a name is given begins, and its whole: within quotes, or up to a space less closing marks.
NAMED = rf"(?i)(?<=[\s\"'`:=])(?=[^\s\"'`:=])(?<=(?<![a-z])(?:{NAMES})(?:[\"']?\s?[:=]>?|\s(?:is|was))?[\s\"'`:=]{{1,3}})"
QUOTED, PLAIN = "^([^\"'`\n]{1,200})[\"'`]", "^([^\\s\"'`]*[^\\s\"'`.,;:)\\]}>])"
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "hexes", "changes", "distinct", "covered", "prefix", "named", "named_far", "digest_named", "risky_path", "harmless_path", "followed", "unlikely", "spaces")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, place, candidate, before, after): place counts words from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.split(text, SEPARATORS).alias("w"), F.split(text, NAMED).alias("pieces"))
    is_one = lambda w: (F.octet_length(w) >= LEAST) & (w.rlike(SHAPE) | (w.rlike(KEYS) & (w.rlike(PREFIX) | w.rlike(UNLIKELY))))
    plain = F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: is_one(F.get("w", i))), lambda i: F.struct(i.alias("place"), F.get("w", i).alias("candidate")))
    # what names are given: pieces of the text after the first; their places are the words of all pieces before
    count = lambda x: F.size(F.filter(F.split(x, SEPARATORS), lambda w: w != ""))
    start = F.when((F.get("w", F.lit(0)) == "") & (F.size("w") > 1), 1).otherwise(0)
    none = F.expr("cast(array() as array<struct<place: int, candidate: string>>)")
    whole = lambda last, x: F.when(last.rlike("[\"'`]$") & x.rlike(QUOTED), F.regexp_extract(x, QUOTED, 1)).otherwise(F.regexp_extract(x, PLAIN, 1))
    begin = F.struct(start.cast("int").alias("place"), F.lit("").alias("last"), none.alias("found"))
    step = lambda s, x: F.struct((s["place"] + count(x)).alias("place"), x.alias("last"), F.when(s["last"] == "", s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(s["place"].alias("place"), whole(s["last"], x).alias("candidate"))))).alias("found"))
    named = F.when(F.size("pieces") > 1, F.aggregate("pieces", begin, step)["found"]).otherwise(none)
    named = F.filter(named, lambda f: F.octet_length(f["candidate"]) >= LEAST_NAMED)
    found = words.select("doc_id", "path", "w", F.explode(F.array_union(plain, named)).alias("f")).select("doc_id", "path", "w", "f.*")
    at = lambda k: F.coalesce(F.get("w", F.col("place") + k), F.lit(""))
    after = at(F.greatest(F.lit(1), count(F.col("candidate"))))
    return found.select("doc_id", "path", F.col("place").cast("long").alias("place"), "candidate", F.lower(F.concat_ws(" ", at(-2), at(-1))).alias("before"), F.lower(after).alias("after"))


def features(found: DataFrame) -> DataFrame:
    """``found`` with a column per feature."""
    c, n = F.col("candidate"), F.char_length("candidate")
    share = lambda kept: (F.char_length(F.regexp_replace(c, kept, "")) / n).cast("double")
    # kinds of characters, then the places where the kind changes
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "#"), "[a-z]", "a"), "[A-Z]", "A"), "[^#aA]", "-")
    changes = F.char_length(F.regexp_replace(kinds, r"(.)(?=\1)", "")) / n
    says = lambda text, words: F.coalesce(F.col(text), F.lit("")).rlike(words).cast("double")
    return (
        found.withColumn("length", F.least(n, F.lit(256)).cast("double"))
        .withColumns({"digits": share("[^0-9]"), "uppers": share("[^A-Z]"), "lowers": share("[^a-z]"), "marks": share("[A-Za-z0-9]"), "hexes": share("[^0-9a-f]")})
        .withColumns({"changes": changes.cast("double"), "distinct": (F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64))).cast("double")})
        .withColumn("covered", (1 - F.char_length(F.regexp_replace(F.lower(c), DICTIONARY, "")) / n).cast("double"))
        .withColumn("prefix", c.rlike(PREFIX).cast("double"))
        .withColumns({"named": says("before", rf"(^|\W)({NAMES})$"), "named_far": says("before", rf"(^|\W)({NAMES})\W"), "digest_named": says("before", rf"(^|\W)({DIGESTS})($|\W)")})
        .withColumns({"risky_path": says("path", RISKY_PATHS), "harmless_path": says("path", HARMLESS_PATHS), "followed": (F.col("after") != "").cast("double")})
        .withColumns({"unlikely": c.rlike(UNLIKELY).cast("double"), "spaces": share("\\S")})
    )


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 5, max_findings: int = MAX_FINDINGS) -> RandomForestClassificationModel:
    """A forest from labelled findings: candidate, before, after, path, label (1: secret)."""
    used = findings.filter(F.col("candidate").isNotNull() & F.col("label").isNotNull() & (F.col("candidate") != ""))
    used = used.orderBy(F.xxhash64("candidate", "before", "label")).limit(max_findings)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(common.cut(used)).withColumn("label", F.col("label").cast("double")))
    rows = common.cut(rows.select("features", "label"))
    if sorted(r["label"] for r in rows.select("label").distinct().limit(3).collect()) != [0.0, 1.0]:
        raise ValueError("labelled findings need both labels, 0 and 1")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, **columns) -> DataFrame:
    """Every candidate with ``score`` (chance of a secret) and ``is_secret``."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(candidates(docs, **columns)))
    score = vector_to_array(F.col("probability")).getItem(1)
    return model.transform(rows).select("doc_id", "path", "place", "candidate", "before", "after", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))


def labelled_findings(spark, n: int = 12_000, seed: int = 3) -> DataFrame:
    """Made findings with labels, for where no reviewed ones are at hand: shapes of secrets and of others, each in varied neighbourhoods."""
    i = F.col("id")
    raw = lambda k, m=64: F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(k), i.cast("string")), 256), 1, m)
    base = lambda k, m: F.substring(F.regexp_replace(F.base64(F.unhex(raw(k))), "[+/=]", "x"), 1, m)
    pick = lambda k, words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(F.lit(k), F.lit(seed), i), F.lit(len(words))) + 1).cast("int"))
    digits = lambda k, m: F.substring(F.regexp_replace(F.concat(raw(k), raw(k + "b")), "[a-f]", ""), 1, m)
    syllables = lambda k: F.concat(pick(k + "1", ["report", "chapter", "image", "release", "version", "figure", "table", "build"]), pick(k + "2", ["-", "_", "."]), pick(k + "3", ["server", "client", "index", "draft", "section", "data"]), F.lit("-"), digits(k, 3))
    filler = pick("f", ["the of", "ention de", "und der", "que la", "with in", "re ation", "this is", "en las"])
    keyed = F.when(F.pmod(F.xxhash64(F.lit("named"), i), F.lit(4)) > 0, F.concat(pick("a", ["my", "the", "export", "set"]), F.lit(" "), pick("n", NAMES.split("|")))).otherwise(filler)
    digest = F.when(F.pmod(F.xxhash64(F.lit("dig"), i), F.lit(4)) > 0, F.concat(pick("b", ["file", "git", "at", "see"]), F.lit(" "), pick("d", DIGESTS.split("|")))).otherwise(filler)
    shapes = [
        (F.concat(F.lit("AKIA"), F.substring(F.upper(F.translate(base("ak", 24), "01", "ZY")), 1, 16)), F.when(i % 20 < 10, filler).otherwise(keyed), 1),
        (raw("tok", 40), keyed, 1),
        (raw("pw", 18), F.concat(filler, F.lit(" password")), 1),
        (F.concat(F.lit("ghp_"), base("gh", 36)), keyed, 1),
        (base("b64", 40), keyed, 1),
        (digits("card", 16), filler, 0),
        (F.concat(pick("m", ["anna", "bosbt", "thleo", "info", "in"]), F.lit("."), digits("mail", 2), F.lit("@mail"), digits("host", 1), F.lit(".example.com")), filler, 0),
        (syllables("doc"), filler, 0),
        (raw("sum", 40), digest, 0),
        (F.regexp_replace(raw("uuid", 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), digest, 0),
    ]
    letters = lambda k, m: F.substring(F.translate(base(k, 43), "0123456789", "qXzJkVwBfG"), 1, m)
    prose = pick("w1", ["information", "points", "control", "between", "through", "generation", "strength", "management", "Angstschweiss", "required", "ordinary", "mention", "policies", "holder's", "number"])
    password = F.concat(pick("q1", ["tree", "Hunter", "sunny", "Pa", "blue", "x"]), pick("q2", ["!", "$", "#", "&", "%", "*", "-"]), F.substring(raw("q"), 1, 4), pick("q3", ["!", "?", "", "$x", "#K"]))
    phrase = F.concat(pick("r1", ["correct", "river", "purple"]), pick("r4", [" ", "-", "."]), pick("r2", ["horse", "stone", "cloud"]), pick("r4", [" ", "-", "."]), pick("r3", ["battery", "letter", "garden"]))
    shapes += [
        (F.concat(F.lit("AKIA"), F.upper(letters("ak2", 16))), filler, 1),
        (letters("let", 24), keyed, 1),
        (F.lower(letters("low", 20)), keyed, 1),
        (password, F.concat(filler, F.lit(" "), pick("n2", ["password", "passwd", "pwd", "secret"])), 1),
        (phrase, F.concat(filler, F.lit(" "), pick("n3", ["password", "passwd", "secret"])), 1),
        (prose, keyed, 0),
        (prose, keyed, 0),
        (F.concat(pick("c1", ["get", "set", "find", "make"]), pick("c2", ["Element", "Report", "Server", "Index"]), pick("c3", ["ById", "FromPage", "WithName"]), pick("c4", ["AndData", "InFile", "OrUser"])), keyed, 0),
        (F.concat(pick("g1", ["Angstschweiss", "Rechtschreib", "Wirtschafts", "Lengthstr"]), pick("g2", ["pruefung", "ordnung", "bericht"])), filler, 0),
        (F.concat(prose, F.lit(" "), pick("w2", ["of the", "and then", "must be"])), keyed, 0),
    ]
    columns = [F.struct(c.alias("candidate"), b.alias("before"), F.lit(label).alias("label")) for c, b, label in shapes]
    x = F.element_at(F.array(*columns), (F.pmod(i, F.lit(len(shapes))) + 1).cast("int"))
    path = pick("p", ["src0", "src7", "config/app.yml", "tests/fixture.py", "docs/readme.md", ".env"])
    return spark.range(n).select(x["candidate"].alias("candidate"), x["before"].alias("before"), filler.alias("after"), path.alias("path"), x["label"].alias("label"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every candidate of every document with score and verdict; the candidate itself only as a digest."""
    found = scan(common.table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
    return found.select("doc_id", "place", F.char_length("candidate").cast("long").alias("n_chars"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "is_secret")
