"""Secret scans: fixed patterns, and strings that a battery of randomness tests can't tell from chance.

Fixed patterns find assignments to names such as ``password``, access keys and long hexadecimal
strings. Beyond them every run of 20 and more letters, digits and ``+ / _ -`` is a candidate. Its
encoding is the smallest alphabet that has all its characters (hexadecimal, base 32, one-case
alphanumeric, base 62, base 64 with either pair of signs); digits alone are never a secret. Three
tests ask whether its characters could be drawn from that alphabet evenly: chi-squared of the
counts, Wald and Wolfowitz's runs above and below the alphabet's middle, and the serial
correlation of neighbours. A candidate fails the battery if the smallest of the three p-values,
times three, is under ``RANDOM``.

Short strings pass such tests for want of evidence, whatever they are. So a candidate must also be
unlike text: for strings of its length whose characters come as they do in all texts, mean and
variance of chi-squared are known exactly (moments of multinomial pairs), and the chance that text
looks as even as the candidate is its p-value; the longer a string, the smaller it can get. These
p-values go, per encoding and length class (powers of two), through Benjamini and Hochberg's
procedure: among the strings reported of a class, at most a share of ``FDR`` is expected to be
text. p-values are rounded up to twentieths of a decade, so the procedure needs only counts per
class and step, and is exact on the rounded values; a class has one threshold, and all of them
together are some hundred numbers.

All of it is DataFrame and SQL functions. Positions are code points, found by summing the lengths
of matches and of what lies between them, in blocks, so that a text with many matches stays linear.

Edge cases: a null or empty text has no spans, and the digest of the empty string; repeated rows
and rows with a null id come back one for one; an empty table gives an empty result; a candidate
that overlaps a span of a fixed pattern isn't reported again; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, read

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The runs are maximal, so asking for their length in the pattern equals asking for it afterwards.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, the smallest first: name, pattern of the whole string, alphabet in its natural order.
ENCODINGS = (
    ("hex", "[0-9a-f]+", DIGITS + LOWER[:6]),
    ("hex_upper", "[0-9A-F]+", DIGITS + UPPER[:6]),
    ("base32", "[A-Z2-7]+", UPPER + DIGITS[2:8]),
    ("base36", "[0-9a-z]+", DIGITS + LOWER),
    ("base36_upper", "[0-9A-Z]+", DIGITS + UPPER),
    ("base62", "[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("base64", "[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", "[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"),
)
#: The battery's level, and the share of reported strings of a class that may be text.
RANDOM, FDR = 1e-4, 0.01
#: Steps a decade to which p-values are rounded up, and the last step.
STEPS, LAST = 20, 6000
#: Matches whose positions are summed as one block.
BLOCK = 256


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(text: str, pattern: str, some: str) -> Column:
    """Matches of a pattern in a text column as (start, stop, hit), in order; start and stop are code points. some: a cheap condition without which a text has none."""
    regex = quoted(pattern)
    gaps = f"transform(arrays_zip(split({text}, {regex}, -1), regexp_extract_all({text}, {regex}, 0)), x -> struct(length(x.`0`) AS gap, x.`1` AS hit))"
    found = f"filter({gaps}, x -> x.hit IS NOT NULL)"
    nothing, nothing_yet = "array(struct(0 AS start, 0 AS stop, '' AS hit))", "array(struct(0 AS gap, '' AS hit))"
    add = "struct(element_at(a, -1).stop + x.gap AS start, element_at(a, -1).stop + x.gap + length(x.hit) AS stop, x.hit AS hit)"
    block = f"aggregate(slice(g, b * {BLOCK} + 1, {BLOCK}), array(element_at(done, -1)), (a, x) -> concat(a, array({add})))"
    # the first element of each list is the one before it
    blocks = f"aggregate(sequence(0, (size(g) - 1) DIV {BLOCK}), {nothing}, (done, b) -> concat(done, slice({block}, 2, {BLOCK})))"
    return F.expr(f"element_at(transform(array(if({some}, {found}, slice({nothing_yet}, 2, 1))), g -> if(size(g) = 0, slice({nothing}, 2, 1), slice({blocks}, 2, size(g)))), 1)")


def log_erfc(x: str) -> str:
    """SQL for the natural logarithm of erfc(x), x >= 0, to about 1e-7 (a published Chebyshev fit)."""
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    nested = f"{fit[-1]}D"
    for c in reversed(fit[:-1]):
        nested = f"({c}D + t * {nested})"
    return f"element_at(transform(array(1D / (1D + 0.5D * ({x}))), t -> ln(t) - ({x}) * ({x}) + {nested}), 1)"


def log_upper(z: str) -> str:
    """SQL for the logarithm of the normal chance of more than z."""
    half = log_erfc(f"abs({z}) / sqrt(2D)")
    return f"if({z} >= 0, {half} - ln(2D), ln(1D - 0.5D * exp({half})))"


def pair_moments(counts: dict[str, int]) -> list[tuple[float, float]]:
    """Of each encoding: the sums of squares and of cubes of its characters' shares in text. Without any text: even shares."""
    out = []
    for _, _, alphabet in ENCODINGS:
        total = sum(counts[c] for c in alphabet)
        shares = [counts[c] / total if total else 1 / len(alphabet) for c in alphabet]
        out.append((sum(p**2 for p in shares), sum(p**3 for p in shares)))
    return out


def character_counts(text: DataFrame) -> dict[str, int]:
    """How often each character of the alphabets stands in all texts."""
    every = sorted(set("".join(a for _, _, a in ENCODINGS)))
    chars = text.select(F.explode(F.split("text", "")).alias("c")).where(F.col("c").isin(every))
    return dict.fromkeys(every, 0) | {r.c: r.n for r in chars.groupBy("c").agg(F.count("*").alias("n")).collect()}


def tested(cands: str, moments: list[tuple[float, float]]) -> Column:
    """Candidates (start, stop, hit) that have an encoding, as (start, stop, class, step); step LAST + 1 stands for those that fail the battery."""
    choice = " ".join(f"WHEN body RLIKE '^{p}$' THEN {k}" for k, (_, p, _) in enumerate(ENCODINGS))
    alphabets = "array(" + ", ".join(quoted(a) for _, _, a in ENCODINGS) + ")"
    q2, q3 = ("array(" + ", ".join(f"{m[k]!r}D" for m in moments) + ")" for k in (0, 1))
    step1 = f"filter(transform({cands}, c -> element_at(transform(array(rtrim('=', c.hit)), body -> struct(c.start, c.stop, body, CASE WHEN body RLIKE '^[0-9]+$' THEN NULL {choice} END AS code)), 1)), c -> c.code IS NOT NULL)"
    step2 = f"""transform({step1}, c -> element_at(transform(array({alphabets}[c.code]), letters -> struct(
        c.start, c.stop, c.body, c.code, letters, length(letters) AS k, length(c.body) AS n, transform(split(c.body, ''), x -> cast(locate(x, letters) - 1 AS long)) AS codes)), 1))"""
    step3 = f"""transform({step2}, c -> struct(c.start, c.stop, c.code, cast(c.n AS double) AS n, cast(c.k AS double) AS k,
        aggregate(split(c.letters, ''), 0D, (s, x) -> s + power(c.n - length(replace(c.body, x, '')), 2)) * c.k / c.n - c.n AS chi,
        cast(size(filter(c.codes, x -> 2 * x >= c.k)) AS double) AS high,
        1D + aggregate(zip_with(slice(c.codes, 1, c.n - 1), slice(c.codes, 2, c.n - 1), (a, b) -> if((2 * a >= c.k) = (2 * b >= c.k), 0, 1)), 0D, (s, x) -> s + x) AS runs,
        cast(aggregate(c.codes, 0L, (s, x) -> s + x) AS double) AS s1, cast(aggregate(c.codes, 0L, (s, x) -> s + x * x) AS double) AS s2,
        cast(aggregate(zip_with(c.codes, concat(slice(c.codes, 2, c.n - 1), slice(c.codes, 1, 1)), (a, b) -> a * b), 0L, (s, x) -> s + x) AS double) AS s12))"""
    variance = "power(c.k / c.n, 2) * 2 * c.n * (c.n - 1) * (q2 + 2 * (c.n - 2) * q3 - (2 * c.n - 3) * q2 * q2)"
    pairs = "2 * c.high * (c.n - c.high)"
    step4 = f"""transform({step3}, c -> element_at(transform(array(struct({q2}[c.code] AS q2, {q3}[c.code] AS q3)), q -> struct(c.start, c.stop, c.code, c.n,
        (power(greatest(c.chi, 0D) / (c.k - 1), 1D / 3) - (1 - 2 / (9 * (c.k - 1)))) / sqrt(2 / (9 * (c.k - 1))) AS z_even,
        if({pairs} = 0 OR {pairs} <= c.n, 1e3D, abs(c.runs - 1 - {pairs} / c.n) / sqrt({pairs} * ({pairs} - c.n) / (c.n * c.n * (c.n - 1)))) AS z_runs,
        if(c.n * c.s2 = c.s1 * c.s1, 1e3D, abs((c.n * c.s12 - c.s1 * c.s1) / (c.n * c.s2 - c.s1 * c.s1) + 1 / (c.n - 1)) * (c.n - 1) / sqrt(c.n * (c.n - 3) / (c.n + 1))) AS z_serial,
        (c.chi - (c.k * (1 + (c.n - 1) * q.q2) - c.n)) / sqrt(greatest({variance.replace("q2", "q.q2").replace("q3", "q.q3")}, 1e-9D)) AS z_text)), 1))"""
    battery = f"least({log_upper('c.z_even')}, {log_erfc('c.z_runs / sqrt(2D)')}, {log_erfc('c.z_serial / sqrt(2D)')}) + ln(3D) >= ln({RANDOM}D)"
    step5 = f"""transform({step4}, c -> struct(c.start, c.stop, cast(c.code * 64 + floor(log2(c.n)) AS int) AS class,
        cast(if({battery}, least(greatest(floor(-{STEPS}D * ({log_upper('(-c.z_text)')}) / ln(10D)), 0), {LAST}), -1) AS int) AS step))"""
    return F.expr(step5)


def thresholds(cands: DataFrame) -> dict[int, int]:
    """Benjamini and Hochberg's threshold of each class that has one: the smallest step that is reported.

    cands: (class, step), a row for each candidate. A class has at most LAST + 2 different steps.
    """
    counts = cands.groupBy("class", "step").agg(F.count("*").alias("n"))
    ranked = counts.select("class", "step", F.sum("n").over(Window.partitionBy("class").orderBy(F.desc("step"))).alias("rank"), F.sum("n").over(Window.partitionBy("class")).alias("m"))
    found = ranked.where((F.col("step") >= 0) & (F.pow(F.lit(10.0), -F.col("step") / STEPS) <= FDR * F.col("rank") / F.col("m")))
    return {r["class"]: r["step"] for r in found.groupBy("class").agg(F.min("step").alias("step")).collect()}


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random (spans of each kind), base_spans and spans: arrays of (start, rank, stop, kind) in order."""
    ws = Workspace(df.sparkSession, "secret-scan")
    texts = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    moments = pair_moments(character_counts(texts.select("text")))
    named = lambda hits, rank: f"transform({hits}, h -> struct(h.start, {rank} AS rank, h.stop, '{KINDS[rank]}' AS kind))"
    lower, run = "lower(text)", f"text RLIKE {quoted('[A-Za-z0-9+/_-]{20}')}"
    texts = texts.withColumns({"named": F.expr(" OR ".join(f"contains({lower}, '{w}')" for w in ("pass", "secret", "token", "api"))), "run": F.expr(run)})
    found = texts.select(
        "doc_id", located("text", ASSIGN, "named").alias("assign"), located("text", ACCESS, "contains(text, 'AKIA')").alias("access"),
        located("text", HEX, "run").alias("hex"), located("text", CANDIDATE, "run").alias("cands"))
    base = ", ".join([named(f"filter(assign, h -> length(regexp_extract(h.hit, {quoted(ASSIGN)}, 2)) >= 8)", 0), named("access", 1), named("hex", 2)])
    found = found.select("doc_id", F.expr(f"array_sort(concat({base}))").alias("base"), "cands")
    apart = "filter(cands, c -> NOT exists(base, b -> b.start < c.stop AND c.start < b.stop))"
    found = found.select("doc_id", "base", F.expr(apart).alias("cands"))
    found = ws.save(found.select("doc_id", "base", tested("cands", moments).alias("cands")), "found")

    bar = thresholds(found.select(F.explode("cands").alias("c")).select("c.class", "c.step"))
    reported = "filter(cands, c -> false)"
    if bar:
        reported = f"filter(cands, c -> c.step >= coalesce(map({', '.join(f'{k}, {v}' for k, v in sorted(bar.items()))})[c.class], {LAST + 1}))"
    out = found.select("doc_id", "base", F.expr(named(reported, 3)).alias("random"))
    number = lambda rank: F.expr(f"cast(size(filter(base, b -> b.rank = {rank})) AS long)")
    return out.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.size("random").cast("long").alias("n_random"),
        F.col("base").alias("base_spans"), F.expr("array_sort(concat(base, random))").alias("spans"))


def listed(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"), "n_random")
