"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame expressions only. A candidate is a long run of key characters with a digit, or the value
assigned to a name that holds a credential's name (DB_PASSWORD, slack_token). Its features: length, share of distinct
characters, transitions between character classes and of the language's frequent letter pairs, shares of digits and
capitals, dictionary coverage, the path, and the words before and after it. Dictionary and letter
pairs come from the corpus itself: the WORDS most frequent words of all documents. The forest is trained on labelled
findings, which labelled_findings() makes by rule (each kind crossed with paths and with words on both sides, so
their number does not depend on the data); their features come from the same expressions, and the fitted trees become
nested conditions that Spark compiles. A row's candidates are judged inside the row: no join,
and a text with many candidates is no group of its own. The only shuffle is that of the words' counts, which are
combined before it.

Defined cases: a null text has no candidate and stays null; every occurrence is judged on its own,
so repeated rows and texts agree; a null source counts as an empty path; a score on the threshold is a secret; a corpus without words has
the fixed dictionary only; other columns pass through
scan() and redact(), and a column of docs named findings is replaced. Bytes that are not UTF-8 are read as Java reads them.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfix.llm.common import fresh

NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential"
RUN = r"[A-Za-z0-9+/=_\-]"
NAMED = rf"(?i:[A-Z0-9_\-]*(?:{NAMES})[A-Z0-9_\-]*)[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
ASSIGNED = rf"(?<![A-Za-z0-9_\-]){NAMED}[^\s\"']{{8,}}"
CANDIDATE = rf"{ASSIGNED}|(?<!{RUN})(?=[A-Za-z+/=_\-]*+[0-9]){RUN}{{16,}}+"
VALUE = rf"^{NAMED}"
MASK = "[SECRET]"
CONTEXT = 48

# Words that speak for and against a secret, words of placeholders, paths of files without real secrets.
FOR = "token|secret|passw|pwd|key|auth|credential|bearer|login"
AGAINST = "sha|md5|commit|checksum|digest|hash|etag|uuid|id|rev|version|build|serial|isbn|invoice|phone|tracking|order|base64|https?"
DENIALS = "example|sample|dummy|placeholder|fake|checksum|digest|hash|not a secret"
PLACEHOLDERS = "example|sample|placeholder|dummy|changeme|default|your|here|test|key|token|secret|password|value|string|version|release"
BENIGN_PATH = r"(?:^|[/\\._\-])(?:tests?|examples?|docs?|samples?|fixtures?|mocks?)(?:$|[/\\._\-])"

FEATURES = ("length", "distinct", "turns", "pairs", "digits", "capitals", "hex", "coverage", "path", "left_for", "left_against", "right_against", "assigned")
#: Words of the corpus in the dictionary, frequent letter pairs; findings of each kind.
WORDS, PAIRS, FINDINGS = 300, 40, 60
TREES, DEPTH, LEAF, THRESHOLD = 25, 7, 4, 0.5


def frequent_words(docs: DataFrame, most: int = WORDS) -> list[tuple[str, int]]:
    """The most frequent words of 4 to 12 letters a-z in all texts, with their counts (ties by the word)."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])[a-z]{4,12}(?![a-z])"), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [(r["word"], r["n"]) for r in counts.collect()]


def frequent_pairs(words: list[tuple[str, int]], most: int = PAIRS) -> list[str]:
    """The letter pairs that follow one another most often in the words."""
    seen: dict[str, int] = {}
    for word, n in words or [(w, 1) for w in PLACEHOLDERS.split("|")]:
        for a, b in zip(word, word[1:], strict=False):
            seen[a + b] = seen.get(a + b, 0) + n
    return sorted(seen, key=lambda p: (-seen[p], p))[:most]


def dictionary(words: list[str]) -> list[str]:
    """All words to look for, the longest first."""
    return sorted({*PLACEHOLDERS.split("|"), *words}, key=lambda w: (-len(w), w))


def features(value: Column, left: Column, right: Column, path: Column, model: dict) -> Column:
    """A struct of the features; left and right are the text beside the candidate. model: words and pairs."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    low = F.lower(value)

    def share(pattern: str, of: Column = value) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    turn = "|".join(f"(?<=[{a}])(?=[{b}])" for a in ("0-9", "a-z", "A-Z", "+/=_-") for b in ("0-9", "a-z", "A-Z", "+/=_-") if a != b)
    known = "|".join(dictionary(model["words"]))
    flag = lambda c: c.cast("double")
    columns = (
        n,
        F.size(F.array_distinct(F.split(value, ""))) / n,
        share(turn),
        share(f"(?=(?:{'|'.join(model['pairs'])}))", low),
        share("[0-9]"),
        share("[A-Z]"),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        (n - F.length(F.regexp_replace(low, known, ""))) / n,
        flag(F.coalesce(path, F.lit("")).rlike(f"(?i){BENIGN_PATH}")),
        flag(left.rlike(f"(?i){FOR}")),
        flag(left.rlike(rf"(?i)\b(?:{AGAINST})")),
        flag(right.rlike(rf"(?i)\b(?:{DENIALS})\b")),
        flag(left.rlike(r"[:=]\s*[\"']?$")),
    )
    return F.struct(*[c.cast("double").alias(name) for c, name in zip(columns, FEATURES, strict=True)])


# ---------------------------------------------------------------- labelled findings


def labelled_findings(spark: SparkSession, each: int = FINDINGS, words: list[str] = ()) -> DataFrame:
    """value, left, right, path, secret (0 or 1): `each` rows of every kind, made from digests of their numbers.

    A kind's own label holds unless the path or the words after it deny it: those make it 0.
    """
    rows = spark.range(each)
    words = [*PLACEHOLDERS.split("|"), *words]

    def pick(options: list[str], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", "kind", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))

    name = lambda salt: F.concat(pick(["", "db_", "MY-", "slack_", "app."], salt + 50), pick(["token", "secret", "api_key", "password", "auth_key", "PASSWORD", "ACCESS_KEY"], salt), pick(["", "", "_2", "_prod"], salt + 60))
    quoted = F.concat(name(1), pick([' = "', ": ", "=", " = '", '": "'], 2))
    prose = pick(["as seen in the log of ", "they wrote that ", "page about ", "see also ", "we found ", ""], 3)
    digests = pick(["commit ", "sha256: ", "md5 = ", "checksum ", "etag: ", 'rev="', "build "], 4)
    hexes = F.concat(*[F.sha2(F.concat(F.lit(x), F.col("id").cast("string"), F.col("kind").cast("string")), 256) for x in "ab"])
    base = F.translate(F.base64(F.unhex(hexes)), "\r\n", "")
    plain = F.translate(base, "+/=", "xyz")
    number = F.substring(F.regexp_replace(F.concat(hexes, hexes, hexes), "[a-f]", ""), 1, 16)
    slug = F.concat_ws("-", *[pick(words, 20 + i) for i in range(4)])
    length = lambda least, salt: (F.pmod(F.xxhash64("id", "kind", F.lit(salt)), F.lit(24)) + least).cast("int")
    kinds = [
        (F.substring(hexes, 1, 40), quoted, 1),
        (F.upper(F.substring(hexes, 3, 40)), F.upper(quoted), 1),
        (F.substring(hexes, 1, 32), quoted, 1),
        (F.substring(hexes, 1, 64), quoted, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(plain, 1, 16))), pick(["aws_access_key_id = ", "", "key: ", 'access_key = "'], 5), 1),
        (F.concat(pick(["ghp_", "gho_", "glpat-"], 6), F.substring(plain, 1, 36)), prose, 1),
        (F.substr(base, F.lit(1), length(24, 7)), F.concat(F.lit("aws_secret_access_key"), pick([" = ", "=", ": "], 8)), 1),
        (F.concat(pick(["sk-", "sk_live_", "xoxb-", "pk_"], 9), F.substr(plain, F.lit(5), length(16, 10))), quoted, 1),
        (F.substr(plain, F.lit(7), length(10, 11)), quoted, 1),
        (F.concat(pick(words, 12), F.substring(number, 1, 2), pick(words, 13), F.substring(number, 3, 1)), F.concat(pick(["password", "passwd: ", "pwd"], 14), pick([": ", "=", ' = "'], 15)), 1),
        (F.concat(F.initcap(pick(words, 16)), pick(["&", "!", "#", "_"], 17), F.substring(plain, 3, 7)), F.concat(pick(["DB_PASSWORD", "password", "login_secret"], 18), pick(["=", ": "], 19)), 1),
        (F.substring(hexes, 1, 40), digests, 0),
        (F.substring(hexes, 1, 64), digests, 0),
        (F.substring(hexes, 1, 18), digests, 0),
        (F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), pick(["uuid: ", "id ", "request ", ""], 30), 0),
        (number, prose, 0),
        (F.concat(number, F.substring(number, 2, 3)), pick(["invoice ", "order ", "tracking ", "ISBN ", "phone "], 31), 0),
        (F.concat(F.lit("your_"), name(32), F.lit("_here_"), F.col("id").cast("string")), quoted, 0),
        (F.concat(F.lit("EXAMPLE_KEY_"), F.substring(number, 1, 6)), quoted, 0),
        (F.concat(F.repeat(F.lit("x"), 16), F.col("id").cast("string")), quoted, 0),
        (F.concat(slug, F.lit("-"), F.substring(number, 1, 2)), pick(["https://a.org/", "see ", "page ", ""], 33), 0),
        (F.concat(pick(["2023-01-", "2024-11-"], 34), F.lpad(F.pmod("id", F.lit(28)).cast("string"), 2, "0"), F.lit("T10-20-30-release")), prose, 0),
        (F.concat(F.repeat(F.lit("-"), 20), F.col("id").cast("string")), prose, 0),
        (F.concat(pick(words, 35), F.lit("/"), pick(words, 36), F.col("id").cast("string"), F.lit("/"), pick(words, 37)), prose, 0),
        (F.concat(pick(["the-", "my-"], 38), pick(PLACEHOLDERS.split("|"), 39), F.lit("-changeme-default"), F.substring(number, 1, 1)), quoted, 0),
        (F.substr(F.concat(base, base), F.lit(1), length(40, 40)), pick(["data:image/png;base64,", "base64: ", "src=data:font/woff;base64,"], 41), 0),
    ]
    benign = F.pmod(F.xxhash64("id", "kind", F.lit(42)), F.lit(5)) == 0
    denied = F.pmod(F.xxhash64("id", "kind", F.lit(43)), F.lit(6)) == 0
    path = F.when(benign, pick(["tests/test_app.py", "docs/intro.md", "src/examples/a", "fixtures", "mock_data"], 44)).otherwise(pick(["src/app", "", "notes", "web", "config/prod", "deploy/.env", "src0"], 45))
    after = pick(['"', "", "'", '" and', " by mail"], 46)
    right = F.when(denied, F.concat(after, pick(["  # example only", " (dummy)", " is a placeholder", " as checksum", " sample"], 47))).otherwise(F.concat(after, pick(["", "\nhost = db1", " as they said", " for the others"], 48)))
    out = None
    for i, (value, left, secret) in enumerate(kinds):
        part = rows.withColumn("kind", F.lit(i)).select(value.alias("value"), left.alias("left"), right.alias("right"), path.alias("path"), F.when(benign | denied, F.lit(0)).otherwise(F.lit(secret)).alias("secret"))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- forest


def _gini(bad: int, n: int) -> float:
    return 2.0 * bad * (n - bad) / n if n else 0.0


def _grow(rows: list[tuple], draw: random.Random, depth: int):
    """A nested tuple (feature, limit, left, right), or the leaf's share of secrets."""
    bad = sum(r[-1] for r in rows)
    if depth == 0 or bad in (0, len(rows)) or len(rows) < 2 * LEAF:
        return bad / len(rows)
    best = None
    for f in draw.sample(range(len(FEATURES)), 5):
        ordered = sorted(rows, key=lambda r: r[f])
        left_bad = 0
        for i in range(1, len(ordered)):
            left_bad += ordered[i - 1][-1]
            if ordered[i - 1][f] < ordered[i][f] and LEAF <= i <= len(ordered) - LEAF:
                cost = _gini(left_bad, i) + _gini(bad - left_bad, len(ordered) - i)
                if best is None or cost < best[0]:
                    best = cost, f, (ordered[i - 1][f] + ordered[i][f]) / 2
    if best is None:
        return bad / len(rows)
    _, f, limit = best
    return f, limit, _grow([r for r in rows if r[f] <= limit], draw, depth - 1), _grow([r for r in rows if r[f] > limit], draw, depth - 1)


def train(docs: DataFrame, each: int = FINDINGS, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> dict:
    """words and pairs of the corpus, and the forest: bootstrapped trees over the labelled findings (some 1,500 rows of numbers)."""
    counted = frequent_words(docs)
    model = {"words": [w for w, _ in counted], "pairs": frequent_pairs(counted)}
    findings = labelled_findings(docs.sparkSession, each, model["words"])
    columns = [F.col(f"f.{name}") for name in FEATURES]
    rows = findings.select(features(*map(F.col, ("value", "left", "right", "path")), model).alias("f"), "secret").select(*columns, "secret")
    rows = sorted(tuple(r) for r in rows.collect())
    draw = random.Random(seed)
    return model | {"forest": [_grow(draw.choices(rows, k=len(rows)), draw, depth) for _ in range(trees)]}


def probability(forest: list, f: Column) -> Column:
    def node(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        at, limit, left, right = tree
        return F.when(f[FEATURES[at]] <= limit, node(left)).otherwise(node(right))

    out = node(forest[0])
    for tree in forest[1:]:
        out = out + node(tree)
    return out / len(forest)


# ---------------------------------------------------------------- scan


def scan(docs: DataFrame, model: dict | None = None, path: str = "source", names: tuple[str, str] = ("pieces", "findings")) -> DataFrame:
    """docs with two more columns, named `names` (columns of these names are replaced).

    pieces: the text between candidates. findings: for each candidate its value, the name and signs
    before the value (lead), and score.
    """
    model = model or train(docs)
    text, found = F.col("text"), fresh(docs, "_found")
    pieces, findings = names
    some = text.rlike(CANDIDATE)
    where = F.col(path) if path in docs.columns else F.lit("")
    cut = docs.withColumn(pieces, F.when(some, F.split(text, CANDIDATE)).otherwise(F.array(text)))
    cut = cut.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def described(candidate: Column, i: Column) -> Column:
        lead = F.regexp_extract(candidate, VALUE, 0)
        value = F.substr(candidate, F.length(lead) + 1)
        left = F.concat(F.right(F.get(pieces, i), F.lit(CONTEXT)), lead)
        right = F.left(F.get(pieces, i + 1), F.lit(CONTEXT // 2))
        return F.struct(value.alias("value"), lead.alias("lead"), features(value, left, right, where, model).alias("f"))

    judged = F.transform(F.transform(found, described), lambda c: F.struct(c["value"].alias("value"), c["lead"].alias("lead"), probability(model["forest"], c["f"]).alias("score")))
    return cut.withColumn(findings, judged).drop(found)


def is_secret(finding: Column, threshold: float = THRESHOLD) -> Column:
    return finding["score"] >= threshold


def masked(threshold: float = THRESHOLD, names: tuple[str, str] = ("pieces", "findings")) -> Column:
    """The text with every secret's value replaced by MASK, from the columns of scan()."""
    shown = F.transform(names[1], lambda c: F.concat(c["lead"], F.when(is_secret(c, threshold), F.lit(MASK)).otherwise(c["value"])))
    return F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.array_join(F.zip_with(names[0], shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def redact(docs: DataFrame, model: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with secrets masked in text, and n_chars (if it is there) brought up to date."""
    names = fresh(docs, "_pieces"), fresh(docs, "_findings")
    out = scan(docs, model, names=names).withColumn("text", masked(threshold, names))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
