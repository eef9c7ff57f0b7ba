"""Text expressions over Columns: blanks, tags, fences, tokens, hashes, templates' parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSISTANT = "<|im_start|>assistant\n"
SEED = 3407
#: All line ends that Python's splitlines knows.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: Unicode white space: what (?U)\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without Unicode white space at either end; an expression would try each blank inside, and a run of n blanks n times."""
    return F.btrim(col(c), F.lit(SPACES))


def as_text(c, kind: T.DataType | None = None) -> Column:
    """Null as empty; a list's non-null items, one per line."""
    c = col(c)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.filter(c, lambda x: x.isNotNull()), "\n"), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def column_text(df: DataFrame, *names: str) -> Column:
    """The first of names that df has, as text: a missing column falls through, a null one is empty."""
    for n in names:
        if n in df.columns:
            return as_text(n, df.schema[n].dataType)
    return F.lit("")


def first_nonempty(df: DataFrame, names, default: str | None = "") -> Column:
    """Of the columns present, the first value that isn't blank, stripped."""
    found = [F.nullif(strip(as_text(n, df.schema[n].dataType)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default))


def first_truthy(df: DataFrame, names) -> Column:
    """Of the columns present, the first value that isn't null or empty; white space counts as a value."""
    found = []
    for n in names:
        if n not in df.columns:
            continue
        if isinstance(df.schema[n].dataType, T.ArrayType):  # a list of empty items still ends the search
            found.append(F.when(F.size(n) > 0, F.array_join(F.filter(n, lambda x: x.isNotNull() & (x != "")), "\n")))
        else:
            found.append(F.nullif(as_text(n), F.lit("")))
    return F.coalesce(*found, F.lit(""))


def not_blank(c) -> Column:
    return F.length(strip(F.coalesce(col(c), F.lit("")))) > 0


def normalise_for_dedup(c, unicode_safe: bool = False) -> Column:
    """Lower case, single blanks, and only plain signs; unicode_safe keeps all letters and digits."""
    spaced = strip(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " "))
    # all but a-z0-9_<>/| and blanks, said by ranges: Java is seven times slower at the negated class
    return F.regexp_replace(spaced, r"[^\p{L}\p{N}_<>/| ]" if unicode_safe else r"[\x00-\x1f!-.:;=?-^`{}-\x{10ffff}]+", "")


def normalise_patch(c) -> Column:
    return F.lower(strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " ")))


def hash8(c) -> Column:
    """The first eight hexadecimal digits of the SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(col(c).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")


def hash_order(*parts) -> Column:
    """A reproducible shuffle key: SHA-256 of the seed and the row's key."""
    return F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256)


def tag_content(c, tag: str) -> Column:
    """What stands between the first <tag> and the next </tag>, stripped; empty if there is none."""
    c = F.coalesce(col(c), F.lit(""))
    at = F.instr(c, f"<{tag}>")
    rest = F.substr(c, at + len(tag) + 2)
    return F.when((at > 0) & F.contains(rest, F.lit(f"</{tag}>")), strip(F.substring_index(rest, f"</{tag}>", 1))).otherwise("")


def answer_of(c) -> Column:
    return tag_content(c, "answer")


def without_fences(c, marks=("```python", "```py", "```")) -> Column:
    out = col(c)
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit(""))
    return strip(out)


def code_tokens(c, longer_than: int = 2) -> Column:
    """Lower-case identifier-like tokens of at least two signs, longer than given."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"([a-zA-Z_][a-zA-Z0-9_]{1,})"), 1)
    return F.filter(found, lambda t: F.length(t) > longer_than) if longer_than > 1 else found


def identifiers(c) -> Column:
    """Distinct case-sensitive identifiers of three signs or more."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])([a-zA-Z_][a-zA-Z0-9_]{2,})(?![\p{L}\p{N}_])"), 1))


def words(c) -> Column:
    """Runs without white space."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def truncated(c, limit: int, mark: str = "\n...[truncated]") -> Column:
    s = strip(F.coalesce(col(c), F.lit("")))
    if limit <= 0:
        return s
    return F.when(F.length(s) > limit, F.concat(F.regexp_replace(F.substring(s, 1, limit), r"(?U)\s+$", ""), F.lit(mark))).otherwise(s)


def prompt_prefix(c, token: str = ASSISTANT) -> Column:
    """The text up to and with the first assistant token; whole if there is none."""
    c = col(c)
    return F.when(F.contains(c, F.lit(token)), F.concat(F.substring_index(c, token, 1), F.lit(token))).otherwise(c)


def truncated_prompt(c, limit: int, token: str = ASSISTANT) -> Column:
    """Cut to limit signs; a prompt that ends with the assistant token still does."""
    c = F.coalesce(col(c), F.lit(""))
    if limit <= 0:
        return c
    cut = F.when(F.endswith(c, F.lit(token)), F.concat(F.substring(c, 1, max(1, limit - len(token))), F.lit(token))).otherwise(F.substring(c, 1, limit))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def turn(role: str, content: Column) -> Column:
    return F.concat(F.lit(f"<|im_start|>{role}\n"), content, F.lit("<|im_end|>\n"))


def assistant_block(answer: Column, reasoning: Column | None = None) -> Column:
    answer = F.concat(F.lit("<answer>\n"), strip(answer), F.lit("\n</answer><|im_end|>"))
    plain = F.concat(F.lit(ASSISTANT), answer)
    if reasoning is None:
        return plain
    reasoning = strip(reasoning)
    return F.when(reasoning != "", F.concat(F.lit(ASSISTANT + "<reasoning>\n"), reasoning, F.lit("\n</reasoning>\n"), answer)).otherwise(plain)


def reasoning_mode(df: DataFrame, ratio: float = 0.7, names=("instruction", "prompt", "problem_statement", "query", "instance_id")) -> Column:
    """A coin from the row's hash: an absent column is empty, a null one reads None."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("None")) if n in df.columns else F.lit("") for n in names]
    return hash8(F.concat_ws("||", *parts)) / F.lit(0xFFFFFFFF).cast("double") < ratio


def count_of(c, needle: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def contains_any(c, needles) -> Column:
    c = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def shared_tokens(p, r) -> Column:
    """How many tokens two arrays share as multisets: sorted together, each token's counts differ by the signs of its run, so the
    work is that of a sort, however often tokens repeat."""
    signed = lambda tokens, sign: F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(sign).alias("s")))
    every = F.sort_array(F.concat(signed(p, 1), signed(r, -1)))
    state = lambda t, run, apart: F.struct(t.alias("t"), run.alias("run"), apart.alias("apart"))
    start = state(F.lit(None).cast("string"), F.lit(0), F.lit(0))
    step = lambda a, x: F.when(a["t"] == x["t"], state(a["t"], a["run"] + x["s"], a["apart"])).otherwise(state(x["t"], x["s"], a["apart"] + F.abs(a["run"])))
    apart = F.aggregate(every, start, step, lambda a: a["apart"] + F.abs(a["run"]))
    return ((F.size(p) + F.size(r) - apart) / 2).cast("int")


def token_f1(prediction, reference) -> Column:
    """F1 of two texts' white-space tokens as multisets, on the normal form of patches."""
    p, r = words(normalise_patch(prediction)), words(normalise_patch(reference))
    return F.coalesce(F.try_divide(2.0 * shared_tokens(p, r), F.size(p) + F.size(r)), F.lit(0.0))


def percent(mean, low, high) -> Column:
    """An interval in per cent, as reports print it."""
    return F.format_string("%.2f%% [95%% CI %.2f, %.2f]", col(mean) * 100, col(low) * 100, col(high) * 100)
