"""Secret scans: candidates by pattern, then a random forest that removes false positives. DataFrame functions only.

Candidates are the values that a text gives to a key that names a credential, or to anything by an equals sign,
of any length; and runs of letters, digits, `+`, `/`, `_`, `-` (and `=` at the end) that are no plain word: with
letters and digits, a capital after a small letter, six consonants in a row, or 16 characters. The forest sees
their length, the changes between kinds of characters, how much of them dictionary words cover, whether they look
like a path, and the words next to them.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"
RUN = "[A-Za-z0-9+/_-]+={0,2}"
#: What makes a run a candidate without a key.
ODD = "[A-Za-z][+/_-]*[0-9]|[0-9][+/_-]*[A-Za-z]|[a-z][A-Z]|[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{6}|[A-Za-z0-9+/_-]{16}"
#: Names of keys whose values are candidates, and what stands between a key and its value.
KEY = "(?i)(?:token|secret|passw|pwd|pass|pw|api.?key|access.?key|private.?key|credential|auth|bearer)[\\\\w.-]*[\"\'`\\\\])]*"
SIGN = "(?:[:=]+>?|=>)"
NAME = "^[A-Za-z_][\\\\w.-]*={1,3}"
OPEN, CLOSE = "[\"\'`(\\\\[{<]*", "[\"\'`)\\\\]}>,;.]*"
#: Words that made-up paths and identifiers consist of.
NAMES = (
    "the and for with that this from not are was image images file files page user users name data date time test example sample content upload static public assets "
    "index main config service client server account address number value version build release download document report background header footer button style script "
    "get set list item type code node path request response message error event action update create delete"
).split()
#: The shortest and the longest dictionary words.
SHORTEST, LONGEST = 3, 20
NEAR_YES = "token|secret|passw|pwd|\\\\bpass\\\\b|\\\\bpw\\\\b|api.?key|access.?key|private|credential|auth|bearer"
NEAR_NO = "commit|sha|md5|checksum|digest|hash|uuid|guid|revision|etag|order|invoice|isbn|href|src|url|http|version"
FEATURES = [
    "length", "entropy", "digits", "capitals", "smalls", "marks", "changes", "longest_run", "consonants", "distinct", "hex", "known_prefix",
    "dictionary", "slashes", "path", "near_yes", "near_no", "assigned", "quoted",
]
TREES, DEPTH = 40, 9
#: Probability from which a candidate is reported.
REPORT = 0.5


@functools.cache
def dictionary(path: str | None = None) -> str:
    """The words of a vocabulary file in 26 * 26 buckets by their first two letters, `aa,ab ... ,zz`: ` aback abbey ,...`.
    The file is that of a word-level BPE whose tokens end in `</w>` where words end; without a path, that of the
    public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    by: dict[str, list[str]] = {}
    for word in sorted(vocabulary):
        if re.fullmatch(f"[a-z]{{{SHORTEST},{LONGEST}}}</w>", word):
            by.setdefault(word[:2], []).append(word[:-4])
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ",".join(f" {' '.join(by.get(a + b, []))} " for a in letters for b in letters)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, nth, candidate, word, before, after): pos is the word's place in the text, from 0; nth the
    candidate's in the word; before and after hold up to three and two neighbouring words."""
    words = docs.select("doc_id", F.expr(f"split(text, '{SPACE}')").alias("ws"))
    last, last2 = "get(ws, i - 1)", "get(ws, i - 2)"
    esc = lambda pattern: pattern.replace("'", "\\'")
    key, sign, opens, closes, name = esc(KEY), SIGN, esc(OPEN), esc(CLOSE), NAME
    inside = f"w rlike '{key}{sign}{opens}[A-Za-z0-9]' or w rlike '{name}{opens}[^=,;]' or w rlike '://[^/:@]+:[^/@]+@'"
    keyed = f"{inside} or {last} rlike '{key}{sign}$' or {last} rlike '=$' or ({last} rlike '^{sign}$' and ({last} rlike '=' or {last2} rlike '{key}$')) or {last} rlike '(?i)^bearer$'"
    plain = f"w rlike '{ODD}'"
    some = f"filter(transform(ws, (w, i) -> if(w <> '' and ({plain} or coalesce({keyed}, false)), i, -1)), i -> i >= 0)"
    given = keyed.replace("w rlike", "ws[i] rlike")
    near = (
        f"transform({some}, i -> struct(i as pos, ws[i] as word, coalesce({given}, false) as keyed, "
        "array_join(slice(ws, greatest(i - 2, 1), least(i, 3)), ' ') as before, array_join(slice(ws, i + 2, 2), ' ') as after))"
    )
    found = words.select("doc_id", F.explode(F.expr(near)).alias("f")).select("doc_id", "f.*")
    # the value behind the word's own key, if any, without quotes and punctuation around it
    own = f"case when word rlike '://[^/:@]+:[^/@]+@' then regexp_extract(word, '://[^/:@]+:([^/@]+)@', 1) when word rlike '{key}{sign}{opens}[A-Za-z0-9]' then regexp_extract(word, '{key}{sign}(.*)$', 1) when word rlike '{name}{opens}[^=,;]' then regexp_extract(word, '{name}(.*)$', 1) else word end"
    quoted = "regexp_extract(v, '^(@q|@a|`)(.+?)@b1', 2)".replace("@q", '"').replace("@a", "\\'").replace("@b", "\\\\")
    bare = f"regexp_replace(regexp_replace(v, '^{opens}', ''), '{closes}$', '')"
    value = f"transform(array({own}), v -> if({quoted} <> '', {quoted}, {bare}))"
    runs = f"filter(regexp_extract_all(word, '({RUN})', 1), r -> r rlike '{ODD}')"
    each = found.select("*", F.posexplode(F.expr(f"if(keyed, {value}, {runs})")).alias("nth", "candidate"))
    return each.where("candidate <> ''").select("doc_id", "pos", "nth", "candidate", "word", "before", "after")


def features(found: DataFrame, words: str | None = None) -> DataFrame:
    """found with the columns FEATURES, all double; needs candidate, word, before and after. words: a dictionary()."""
    c, n = "candidate", "length(candidate)"
    kinds = f"translate(regexp_replace(regexp_replace(regexp_replace({c}, '[0-9]', '9'), '[A-Z]', 'A'), '[a-z]', 'a'), '+/_-=', '-----')"
    share = f"(length({c}) - length(replace({c}, x, ''))) / {n}"
    at = f"locate({c}, word)"
    # letters between other characters and changes of case are pieces; words that they begin and end with cover them
    known = f"split('{words or dictionary()}', ',')"
    pieces = f"filter(split(lower(regexp_replace({c}, '([a-z])([A-Z])', '$1 $2')), '[^a-z]+'), p -> length(p) >= {SHORTEST})"
    part = lambda cut: f"array_max(transform(sequence({SHORTEST}, least(length(p), {LONGEST})), k -> if(contains(element_at({known}, ascii({cut}) * 26 + ascii(substr({cut}, 2, 1)) - {97 * 27 - 1}), concat(' ', {cut}, ' ')), k, 0)))"
    covered = f"least(length(p), coalesce({part('left(p, k)')}, 0) + coalesce({part('right(p, k)')}, 0))"
    exprs = {
        "length": n,
        "entropy": f"aggregate(array_distinct(split({c}, '')), 0D, (s, x) -> s - if(x = '', 0D, ({share}) * log2({share})))",
        "digits": f"length(regexp_replace({c}, '[^0-9]', '')) / {n}",
        "capitals": f"length(regexp_replace({c}, '[^A-Z]', '')) / {n}",
        "smalls": f"length(regexp_replace({c}, '[^a-z]', '')) / {n}",
        "marks": f"length(regexp_replace({c}, '[A-Za-z0-9]', '')) / {n}",
        "changes": f"(length(regexp_replace({kinds}, '(.)\\\\1+', '$1')) - 1) / {n}",
        "longest_run": f"array_max(transform(regexp_extract_all({kinds}, '((.)\\\\2*)', 1), r -> length(r)))",
        "consonants": f"coalesce(array_max(transform(regexp_extract_all(lower({c}), '([b-df-hj-np-tv-xz]+)', 1), r -> length(r))), 0)",
        "distinct": f"size(array_distinct(split({c}, ''))) / {n}",
        "hex": f"int({c} rlike '^(?:[0-9a-f]+|[0-9A-F]+)$')",
        "known_prefix": f"int({c} rlike '^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[bp]-|AIza)')",
        "dictionary": f"aggregate({pieces}, 0, (s, p) -> s + {covered}) / {n}",
        "slashes": f"length({c}) - length(replace({c}, '/', ''))",
        "path": f"int(word rlike '^[a-z]+://|^[./~]' or substr(word, {at} + {n}, 1) = '.' and substr(word, {at} + {n} + 1, 1) <> '' or ({at} > 1 and substr(word, {at} - 1, 1) = '.'))",
        "near_yes": f"int(lower(concat(before, ' ', substr(word, 1, greatest({at} - 1, 0)))) rlike '{NEAR_YES}')",
        "near_no": f"int(lower(concat(before, ' ', substr(word, 1, greatest({at} - 1, 0)), ' ', after)) rlike '{NEAR_NO}')",
        "assigned": f"int(concat(before, ' ', substr(word, 1, greatest({at} - 1, 0))) rlike '[=:] ?[\"\\']?$')",
        "quoted": f"int({at} > 1 and substr(word, {at} - 1, 1) in ('\"', '\\'', '`'))",
    }
    return found.select("*", *[F.expr(exprs[name]).cast("double").alias(name) for name in FEATURES])


def labelled_findings(spark: SparkSession, n: int = 8000, seed: int = 11) -> DataFrame:
    """Made-up findings with labels: (candidate, word, before, after, secret). The secrets are credentials of several
    makes and lengths, passwords among them; the others are what scanners report wrongly: digests, ids, file paths,
    identifiers, numbers, settings, placeholders, prose."""
    rows = spark.range(0, n, 1, 4).withColumn("r", F.expr(f"sha2(concat(id, ':{int(seed)}'), 512)"))
    pick = lambda salt, many: f"int(pmod(xxhash64(id, '{salt}', {int(seed)}), {many}))"
    letters = lambda alphabet, length, salt: f"array_join(transform(sequence(1, {length}), i -> substr('{alphabet}', int(pmod(xxhash64(id, i, '{salt}', {int(seed)}), {len(alphabet)})) + 1, 1)), '')"
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    caps, mixed = small.upper() + "234567", small + small.upper() + digits
    some = lambda items, salt: f"element_at(array({', '.join(repr(x) for x in items)}), {pick(salt, len(items))} + 1)"
    name = lambda k: some(NAMES, f"w{k}")
    key = some(["token = ", "secret = ", "api_key: ", "password=", "access_key = ", "Authorization: Bearer ", "auth_token=", "pw: ", "passwd = ", "secret: "], "key")
    plain = some(["of the ", "in this and ", "see ", "on the other ", "with "], "plain")
    no = some(["commit ", "sha1: ", "checksum ", "md5=", "digest ", "uuid ", "etag: "], "no")
    setting = some(["width=", "lang = ", "id=", "level = ", "x = ", "color: ", "mode=", "a = "], "set")
    url = some(["postgres://joe:", "mysql://admin:", "https://user:", "amqp://guest:"], "url")
    after = f"concat({some(['token = ', 'secret: ', 'password=', 'api_key = '], 'past')}, substr(r, 60, 24), ' ', {some(['', 'in ', 'the '], 'then')})"
    syllables = lambda k: f"array_join(transform(sequence(1, 2 + {pick(f'many{k}', 3)}), i -> element_at(array('ou', 'tre', 'en', 'pa', 'la', 'the', 'ly', 'st', 'reau', 'ver', 'ung', 'ach'), int(pmod(xxhash64(id, i, 's{k}', {int(seed)}), 12)) + 1)), '')"
    more = f"1 + {pick('more', 3)}"
    secret = [
        ("substr(r, 1, 40)", key), ("substr(r, 1, 32)", key), (f"concat('AKIA', {letters(caps, 16, 'a')})", some(["of the ", "key ", "in this and ", "see ", "aws_access_key_id = "], "aws")),
        (f"concat('ghp_', {letters(mixed, 36, 'b')})", some(["token ", "of the ", "in "], "gh")), (letters(mixed + "+/", 40, "c"), key), (letters(mixed, 24, "d"), key),
        (letters(mixed, f"8 + {pick('l1', 8)}", "e"), key), (f"concat({name(1)}, {letters(digits, more, 'f')}, {name(2)})", key), (f"concat({letters(mixed, '3', 'g')}, {some(list('!#$%&*@'), 'mark')}, {name(3)}, {letters(digits, '1', 'h')})", key),
        (f"concat_ws('.', {name(1)}, {name(2)}, {name(3)}, concat({name(4)}, {letters(digits, '1', 'i')}))", key), (letters(small, f"16 + {pick('l2', 16)}", "j"), key), (letters(small.upper(), f"16 + {pick('l3', 16)}", "k"), key),
        (letters(mixed, f"8 + {pick('l4', 12)}", "l"), url), (f"concat({name(1)}, {letters(digits, more, 'm')}, {name(2)})", url),
    ]
    other = [
        ("substr(r, 1, 40)", no), ("substr(r, 1, 32)", no), (f"concat({name(1)}, '/', {name(2)}, '/', {name(3)}, '-', {name(4)}, {pick('n', 100)})", plain), (f"concat({name(1)}, initcap({name(2)}), initcap({name(3)}), {pick('n', 10)})", plain),
        (f"lpad(string(pmod(xxhash64(id, 'big'), 1000000000000000)), 17, '4')", plain), ("concat_ws('-', substr(r, 1, 8), substr(r, 9, 4), substr(r, 13, 4), substr(r, 17, 4), substr(r, 21, 12))", some(["uuid ", "id ", "of the ", "guid: "], "uu")),
        (some(["changeme", "required", "null", "none", "true", "false", "string", "xxxxxxxx", "password", "your-password", "example", "here"], "hold"), key), (f"string({pick('n', 5000)})", setting), (name(1), setting),
        (f"concat({some(['covid', 'mp', 'v', 'a', 'h', 'utf', 'x'], 'base')}, {pick('n', 99)})", plain), (f"concat({pick('n', 99)}, {some(['nd', 'th', 'kg', 'x', 'mm', 'D', 'pm'], 'unit')})", plain), (f"concat({some(['i', 'Mc', 'e', 'La', 'You'], 'lead')}, initcap({syllables(1)}))", plain),
        (syllables(2), some(["secret: ", "token: ", "password: ", "auth: "], "colon")), (syllables(3), setting), (f"concat({syllables(4)}, {syllables(5)}, {syllables(6)})", plain),
        (f"upper(concat({syllables(4)}, {syllables(5)}))", plain), (f"lpad(string(pmod(xxhash64(id, 'big'), 1000000000000000)), 16, '4')", after), (f"concat({name(1)}, {pick('n', 99)})", after), (f"concat({syllables(7)}, {syllables(8)})", after),
    ]
    kinds = secret + other
    rows = rows.withColumn("kind", F.expr(pick("kind", len(kinds))))
    made = lambda k: F.expr(f"case kind {' '.join(f'when {i} then {m[k]}' for i, m in enumerate(kinds))} end")
    rows = rows.select(made(0).alias("candidate"), made(1).alias("lead"), (F.col("kind") < len(secret)).cast("double").alias("secret"), "id", "r")
    quote = F.expr(f"if(lead rlike '[=:] ?$' and {pick('q', 2)} = 0, '\"', '')")
    rows = rows.withColumn("quote", quote).withColumn("tight", F.expr("regexp_extract(lead, '(\\\\S*)$', 1)"))
    left = F.expr("array_join(slice(split(trim(concat('and the ', substr(lead, 1, length(lead) - length(tight)))), ' '), -3, 3), ' ')")
    suffix = F.expr(f"if(candidate like '%/%/%', {some(['.png', '.html', ''], 'ext')}, '')")
    return rows.select("candidate", F.concat("tight", "quote", "candidate", "quote", suffix).alias("word"), left.alias("before"), F.lit("and the").alias("after"), "secret")


def train(findings: DataFrame, seed: int = 5, words: str | None = None) -> PipelineModel:
    """A random forest on the features of labelled findings (candidate, word, before, after, secret 0 or 1)."""
    forest = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=seed, maxBins=32)
    made = features(findings, words).select(*FEATURES, "secret").persist()
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(made)
    made.unpersist()
    return model


def scan(docs: DataFrame, model: PipelineModel, report: float = REPORT, words: str | None = None) -> DataFrame:
    """One row per candidate of docs: doc_id, pos, nth, candidate, probability, secret.

    Whole texts are scanned; null and empty texts have no candidates. Rows with a null or repeated doc_id give
    their candidates like others, so equal rows give equal findings. An empty table gives an empty result;
    extra columns are ignored.
    """
    scored = model.transform(features(candidates(docs), words))
    out = scored.withColumn("probability", vector_to_array("probability")[1])
    return out.select("doc_id", "pos", "nth", "candidate", "probability", (F.col("probability") >= report).alias("secret"))
