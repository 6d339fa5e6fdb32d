"""Secret scans with a random forest that removes false positives; DataFrame and SQL functions only.

Rules find candidates; a forest trained on labelled findings decides which are secrets. A
candidate's features are its length, how it moves between kinds of characters, how much of it is
common letter pairs or dictionary words, whether it is part of a path, and the words beside it.
The labelled findings are made by rule from hashes (LABELLED of them, see findings()), as
scanners' triage data would be. Spark ML trains the forest on them; its trees are then read out as
one SQL expression, so scanning a text is a projection: no Python, no shuffle, one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

# The names that keys are assigned to.
NAMED = r"(?i:token|secret(?:[_-]?\w{0,40}key)?|passw(?:or)?d|(?:api|access|private)[_-]?key|credential)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
# The shapes of candidates, tried in this order; slashed ones are sought by themselves, since they may hold others.
# A private key goes on to its END if that is the next mark of five dashes with BEGIN or END, else over the lines of its body. Repeats are possessive, so that long keys take no stack and a text is read once.
RULES = {
    "private_key": r"-----BEGIN (?:(?!PRIVATE KEY)[A-Z0-9]+ )*+PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END (?:(?!PRIVATE KEY)[A-Z0-9]+ )*+PRIVATE KEY(?: BLOCK)?-----|(?:\s*+[0-9A-Za-z+/=]{40,}+)*+)",
    "aws_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{36,251}",
    "jwt": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "assigned": NAMED + r"[^\s\"',;<>(){}]{8,}",
    "opaque": r"[0-9A-Za-z+=_-]{20,}",
    "slashed": r"(?<![0-9A-Za-z+/=_-])(?=[0-9A-Za-z+=_-]*/)[0-9A-Za-z+/=_-]{20,}",
}
# Words of names, placeholders and prose that keys do not hold.
DICTIONARY = ["access", "account", "address", "admin", "changeme", "client", "commit", "config", "content", "default", "document", "dummy", "example", "file", "function", "hello", "image", "index", "insert", "license", "local", "message", "module", "name", "number", "object", "option", "package", "page", "param", "password", "placeholder", "private", "public", "release", "request", "sample", "secret", "server", "service", "session", "string", "system", "test", "token", "type", "user", "value", "version", "word", "your"]
# Frequent letter pairs of the languages at hand.
PAIRS = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ch", "de", "ie", "ge", "un", "le", "ou", "qu", "la", "os", "do", "ue", "ra"]
# Words beside a candidate that speak for or against a secret.
FOR = r"(?i)token|secret|passw|api[_-]?key|credential|auth|bearer|login|private"
AGAINST = r"(?i)sha\d|md5|hash|commit|checksum|digest|uuid|integrity|revision|etag|build|example|sample|dummy|test"
PATH = r"(?i)[/\\]|\.(?:html?|json|txt|png|jpe?g|css|js|py|md|xml)\b"
NEIGHBOURS = 40
LABELLED, TREES, DEPTH = 3000, 15, 6
FEATURES = ["length", "digits", "upper", "lower", "other", "moves", "distinct", "pairs", "words", "path", "before_for", "before_against", "quoted", "known"]
_forests: dict[str, str] = {}

CANDIDATE = "|".join(f"(?:{rule})" for k, rule in RULES.items() if k != "slashed")
_ASSIGNMENT = "^" + NAMED


def _sql(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def features(candidate: str, before: str, after: str) -> str:
    """SQL for a struct of FEATURES over the names of three string expressions; value is the candidate without the name it is assigned to."""
    value = f"regexp_replace({candidate}, {_sql(_ASSIGNMENT)}, '')"
    size = f"greatest(length({value}), 1)"
    share = lambda rx: f"regexp_count({value}, {_sql(rx)}) / {size}"
    known = f"case when {candidate} rlike {_sql('^(?:' + '|'.join(RULES[k] for k in ('private_key', 'aws_key', 'github_token', 'jwt')) + ')')} then 1 else 0 end"
    sql = {
        "length": f"length({value})",
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "other": share("[^0-9A-Za-z]"),
        "moves": f"(regexp_count({value}, '[0-9]+') + regexp_count({value}, '[a-z]+') + regexp_count({value}, '[A-Z]+')) / {size}",
        "distinct": f"size(array_distinct(split({value}, ''))) / {size}",
        "pairs": f"regexp_count(lower({value}), {_sql('|'.join(PAIRS))}) / {size}",
        "words": f"1 - length(regexp_replace(lower({value}), {_sql('|'.join(DICTIONARY))}, '')) / {size}",
        "path": f"case when concat(right({before}, 1), {value}, left({after}, 5)) rlike {_sql(PATH)} then 1 else 0 end",
        "before_for": f"case when concat({before}, regexp_extract({candidate}, {_sql(_ASSIGNMENT)}, 0)) rlike {_sql(FOR)} then 1 else 0 end",
        "before_against": f"case when concat({before}, ' ', {after}) rlike {_sql(AGAINST)} then 1 else 0 end",
        "quoted": f"case when {candidate} rlike {_sql(chr(34))} or right({before}, 1) rlike {_sql('[' + chr(34) + chr(39) + ']')} then 1 else 0 end",
        "known": known,
    }
    return "named_struct(" + ", ".join(f"'{k}', cast({sql[k]} as double)" for k in FEATURES) + ")"


def findings(spark: SparkSession, first: int = 0) -> DataFrame:
    """LABELLED labelled findings (candidate, before, after, secret) made from hashes of their numbers, from first on."""
    h, u = "sha2(cast(id as string), 256)", "base64(unhex(sha2(cast(id + 7 as string), 256)))"
    w = lambda k: f"element_at(array({', '.join(repr(x) for x in DICTIONARY)}), cast(pmod(xxhash64(id, {k}), {len(DICTIONARY)}) as int) + 1)"
    prose = "concat_ws('', transform(sequence(1, 10), i -> element_at(array(" + ", ".join(repr(x) for x in PAIRS) + f"), cast(pmod(xxhash64(id, i), {len(PAIRS)}) as int) + 1)))"
    slashed = f"concat(substr({u}, 1, 9), '/', substr({u}, 10, 12), '/', substr({u}, 22))"
    alnum = f"regexp_replace({u}, '[^0-9A-Za-z]', '')"
    key = "element_at(array('token', 'secret', 'password', 'api_key', 'TOKEN', 'apikey', 'credential'), cast(pmod(xxhash64(id, 3), 7) as int) + 1)"
    # candidate, before, after, secret
    kinds = [
        (f"concat({key}, ' = \"', substr({h}, 1, 40))", f"concat({w(1)}, ' ', {prose}, ' ')", "'\" '", 1),
        (f"concat({key}, ' = \"', upper(substr({h}, 1, 40)))", f"concat({prose}, ' ')", "'\" '", 1),
        (f"concat({key}, '=', {alnum})", f"concat({w(1)}, ' ')", "' '", 1),
        (f"concat({key}, ': ', substr({u}, 1, 16), '!x')", "'config '", "'\n'", 1),
        (f"concat('AKIA', upper(substr({h}, 1, 16)))", f"concat({w(2)}, ' ')", "' '", 1),
        (f"concat('ghp_', substr({alnum}, 1, 36))", f"concat({w(2)}, ' ')", "' '", 1),
        (f"concat('eyJ', substr({alnum}, 1, 20), '.', substr({h}, 1, 30), '.', substr({alnum}, 3, 30))", "'auth bearer '", "' '", 1),
        ("'-----BEGIN RSA PRIVATE KEY-----'", f"concat({w(1)}, '\n')", "'\n'", 1),
        (f"substr({alnum}, 1, 32)", "'api_key is '", "' '", 1),
        (f"concat('-----BEGIN PRIVATE KEY-----\n', {u}, '\n', {u}, '\n-----END PRIVATE KEY-----')", f"concat({w(1)}, '\n')", "'\n'", 1),
        (f"concat('-----BEGIN RSA PRIVATE KEY-----\n', repeat('X-Header: a-b-c\n', cast(pmod(xxhash64(id, 4), 50) as int)), repeat(concat({u}, '\n'), 1 + cast(pmod(xxhash64(id, 5), 300) as int)), '-----END RSA PRIVATE KEY-----')", f"concat({w(1)}, '\n')", "'\n'", 1),
        (f"concat('-----BEGIN PRIVATE KEY-----\n', repeat(concat({h}, '\n'), 1 + cast(pmod(xxhash64(id, 6), 900) as int)))", "''", "''", 1),
        (f"concat('secret_access_key = ', substr({slashed}, 1, 40))", "'aws_'", "'\n'", 1),
        (f"concat('SECRET_KEY=', substr({u}, 1, 16))", f"concat({w(1)}, ' ')", "'\n'", 1),
        (f"substr({slashed}, 1, 40)", "'secret access key '", "' '", 1),
        (f"concat('com/', {w(1)}, '/', {w(2)}, '/', {prose})", "'https://www.'", "' '", 0),
        (f"concat('/', {w(1)}, '/', {w(2)}, '/', {prose})", f"concat({prose}, ' ')", "'.py '", 0),
        (f"concat({prose}, '/', {prose})", f"concat({w(1)}, ' ')", "' '", 0),
        (f"concat('com/', {w(1)}, '/2024/10/', {w(2)}, '-', {w(3)})", "'https://www.'", "' '", 0),
        (f"concat({prose}, {prose})", f"concat({w(1)}, ' ')", "' '", 0),
        (f"concat(upper(left({prose}, 1)), substr({prose}, 2))", f"concat({prose}, ' ')", "'. '", 0),
        (f"substr({h}, 1, 40)", "'commit '", "' '", 0),
        (h, "'sha256 checksum '", "' '", 0),
        (f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))", "'uuid '", "' '", 0),
        (f"concat({w(1)}, '_', {w(2)}, '_', {w(3)}, '_', {w(4)})", f"concat({w(5)}, ' ')", "' '", 0),
        (f"concat({w(1)}, '-', {w(2)}, '-', {prose})", f"concat('https://', {w(3)}, '.com/')", "'.html'", 0),
        (f"concat({key}, ' = \"your_', {w(1)}, '_here')", f"concat({w(2)}, ' ')", "'\" '", 0),
        (f"concat({key}, '=xxxxxxxxxxxxxxxx')", f"concat({w(2)}, ' ')", "' '", 0),
        (f"concat({key}, ': ', {prose})", f"concat({prose}, ' the ')", "' '", 0),
        ("repeat('=', 20 + cast(pmod(id, 40) as int))", "'\n'", "'\n'", 0),
        ("repeat('-', 20 + cast(pmod(id, 40) as int))", "'\n'", "'\n'", 0),
        ("lpad(cast(pmod(xxhash64(id), 1000000000) as string), 20, '31415926535')", f"concat({prose}, ' ')", "' '", 0),
    ]
    rows = spark.range(first, first + LABELLED, 1, 1).withColumn("kind", F.expr(f"pmod(xxhash64(id, 99), {len(kinds)})"))
    pick = lambda j: F.expr("case " + " ".join(f"when kind = {k} then {x[j]}" for k, x in enumerate(kinds)) + " end")
    return rows.select(pick(0).alias("candidate"), pick(1).alias("before"), pick(2).alias("after"), pick(3).cast("double").alias("secret"))


def _tree(node, name: str) -> str:
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return f"{float(stats[1] / sum(stats))!r}D"
    split = node.split()
    feature = FEATURES[split.featureIndex()]
    return f"if({name}.{feature} <= {split.threshold()!r}D, {_tree(node.leftChild(), name)}, {_tree(node.rightChild(), name)})"


def forest(spark: SparkSession, name: str) -> str:
    """SQL for the share of trees' votes, over the struct called name; trained once for an application."""
    app = spark.sparkContext.applicationId
    if app not in _forests:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        rows = findings(spark).select("secret", F.expr(features("candidate", "before", "after")).alias("f")).select("secret", "f.*")
        rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows).select("secret", "x")
        model = RandomForestClassifier(featuresCol="x", labelCol="secret", numTrees=TREES, maxDepth=DEPTH, seed=17, subsamplingRate=0.8).fit(rows)
        trees = list(model._java_obj.trees())
        _forests.clear()
        _forests[app] = "(" + " + ".join(_tree(t.rootNode(), "NAME") for t in trees) + f") / {float(len(trees))}D"
    return _forests[app].replace("NAME", name)


def kind(candidate: str) -> str:
    return "case " + " ".join(f"when {candidate} rlike {_sql('^(?:' + rule + ')')} then '{k}'" for k, rule in RULES.items()) + " end"


def _sums(lengths: str) -> str:
    """SQL for the sums of what stands before each element of an array of int.

    In two levels, chunks of about the root of its size: an array is copied as it grows by one, so
    one level would take the square of its size.
    """
    grow = lambda x: f"aggregate({x}, named_struct('at', 0, 'all', cast(array() as array<int>)), (s, v) -> named_struct('at', s.at + v, 'all', concat(s.all, array(s.at))), s -> s.all)"
    chunks = f"transform(array({lengths}), l -> if(size(l) = 0, cast(array() as array<array<int>>), transform(sequence(0, int((size(l) - 1) / ceil(sqrt(size(l))))), k -> slice(l, int(k * ceil(sqrt(size(l))) + 1), int(ceil(sqrt(size(l))))))))"
    totals = "transform(c, x -> aggregate(x, 0, (s, v) -> s + v))"
    return f"flatten(flatten(transform({chunks}, c -> zip_with(transform(c, x -> {grow('x')}), {grow(totals)}, (own, base) -> transform(own, o -> o + base)))))"


def _places(rule: str) -> str:
    """SQL for an array of the matches of rule in text, each with its start; what lies between matches has the lengths that lead to it."""
    cut = f"named_struct('values', regexp_extract_all(text, {_sql(rule)}, 0), 'gaps', transform(split(text, {_sql(rule)}, -1), g -> length(g)))"
    lengths = "transform(m.values, (v, i) -> m.gaps[i] + length(v))"
    starts = f"transform(m.values, (v, i) -> named_struct('value', v, 'start', 1 + b[i] + m.gaps[i]))"
    return f"flatten(flatten(transform(array({cut}), m -> transform(array({_sums(lengths)}), b -> {starts}))))"


def scored(docs: DataFrame, column: str) -> DataFrame:
    """docs with an array, column, of its candidates by occurrence: start (1-based), value, kind, score."""
    hits = docs.withColumn(column, F.expr(f"coalesce(concat({_places(CANDIDATE)}, {_places(RULES['slashed'])}), array())"))
    around = (
        f"transform({column}, c -> named_struct('value', c.value, 'start', c.start, "
        f"'before', substr(text, greatest(c.start - {NEIGHBOURS}, 1), least(c.start - 1, {NEIGHBOURS})), "
        f"'after', substr(text, c.start + length(c.value), 20)))"
    )
    hits = hits.withColumn(column, F.expr(around))
    hits = hits.withColumn(column, F.expr(f"transform({column}, c -> named_struct('value', c.value, 'start', c.start, 'f', {features('c.value', 'c.before', 'c.after')}))"))
    return hits.withColumn(column, F.expr(f"transform({column}, c -> named_struct('start', c.start, 'value', c.value, 'kind', {kind('c.value')}, 'score', {forest(docs.sparkSession, 'c.f')}))"))


def find_secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row per document and occurrence of a candidate: doc_id, start, length, kind, value_sha256, score, is_secret (score >= threshold).

    Null and empty texts have none. Rows keep their multiplicity; a null doc_id is carried; other
    columns are dropped. A value that recurs in a text is judged by the words beside it at each place.
    A slashed candidate may lie in another or hold one. An empty table gives an empty one; texts of any
    length are scanned whole.
    """
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "_found")
    # outer: else Spark would infer a filter on the array's size and scan every text twice
    rows = rows.select("doc_id", F.explode_outer("_found").alias("c")).where("c is not null")
    return rows.select("doc_id", F.col("c.start").alias("start"), F.length("c.value").alias("length"), "c.kind", F.sha2(F.col("c.value").cast("binary"), 256).alias("value_sha256"), F.round("c.score", 6).alias("score"), (F.col("c.score") >= threshold).alias("is_secret"))


def mask_secrets(docs: DataFrame, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """docs, all columns and rows, with every occurrence in text of a value that is a secret at any place masked; n_chars, if there, follows the text.

    Null and empty texts stay as they are, repeated rows are masked each, an empty table stays empty,
    and texts may be of any length: work grows with a text and its candidates.
    """
    found = fresh(docs, "_found")
    rows = scored(docs, found).withColumn(found, F.expr(f"array_distinct(transform(filter({found}, c -> c.score >= {threshold}D), c -> regexp_replace(c.value, {_sql(_ASSIGNMENT)}, '')))"))
    # longer ones first, lest a part of one be masked
    rows = rows.withColumn("text", F.expr(f"aggregate(array_sort({found}, (a, b) -> length(b) - length(a)), text, (t, s) -> replace(t, s, '{mask}'))"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
