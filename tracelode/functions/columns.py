"""Column expressions shared by all operators: identities, text rules, scores. All are built-in expressions unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start of every prefix chain.
PREFIX_SEED = "tracelode:raw-prefix:v1"


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and nulls written out; the form that identities hash."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def typed_id(prefix: str, **fields: Column) -> Column:
    """``prefix_`` and 64 hex digits over the canonical JSON of the fields."""
    return F.concat(F.lit(prefix + "_"), F.sha2(canonical_json(**fields), 256))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and 20 hex digits over the parts, joined by the unit separator; a null part reads ``None``."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 20))


def prefix_seed() -> Column:
    return F.sha2(F.lit(PREFIX_SEED), 256)


def prefix_chain(digests: Column, seed: Column | None = None) -> Column:
    """Folds hex digests in order: h becomes sha256(unhex(h) || unhex(digest))."""
    return F.aggregate(digests, prefix_seed() if seed is None else seed, lambda h, x: F.sha2(F.concat(F.unhex(h), F.unhex(x)), 256))


def machine_key(text: Column) -> Column:
    """Runs of Unicode white space become one blank; trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def line_ends(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def tokens_estimate(text: Column) -> Column:
    """Half the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(2)).cast("long")


def byte_cut(text: Column, limit: int) -> Column:
    """The longest prefix of at most limit UTF-8 bytes that cuts no character, without blanks at its end.

    A text that holds the replacement character itself at the cut loses it too.
    """
    head = F.substring(F.encode(text, "UTF-8"), 1, limit)
    cut = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "�+$", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.regexp_replace(cut, r"(?U)\s+$", ""))


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased, in order: what the lexical index holds."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bucket(token: Column, dimension: int) -> Column:
    """A token's place in a hashing embedding: the first two bytes of its sha256, modulo the dimension."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 4), 16, 10).cast("int") % dimension).cast("int")


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def overlap(query_terms: Column, text_terms: Column) -> Column:
    """Share of the query's distinct terms that the text has."""
    query = F.array_distinct(query_terms)
    return F.size(F.array_intersect(query, text_terms)) / F.greatest(F.lit(1), F.size(query))


#: White space (Unicode's White_Space), and what ends a line; the information separators end lines and are no white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\u0085\\u2028\\u2029]+"


#: Lines of a text that become documents of their own where no other number is given.
LINES = 128


def lines(text: Column, most: int | None = LINES) -> Column:
    """The first non-blank lines, stripped; None: all."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_ENDS), lambda x: F.trim(x, F.lit(WHITE)))
    found = F.filter(every, lambda x: x != "")
    return found if most is None else F.slice(found, 1, most)


def line_id(memory_id: Column, i: Column) -> Column:
    """The document id of a memory's line: its number has four digits, or as many as it needs."""
    n = i.cast("string")
    return F.concat(memory_id, F.lit(":snippet:"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0")))


def first_line(text: Column) -> Column:
    """The first of ``lines``, null without one; only the text up to the first line feed is cut."""
    head = F.substring_index(F.ltrim(text, F.lit(WHITE + "\x1c\x1d\x1e")), "\n", 1)
    return F.nullif(F.trim(F.get(F.split(head, LINE_ENDS, 2), F.lit(0)), F.lit(WHITE)), F.lit(""))


def nearest_rank(column: str, p: float) -> Column:
    """The value at rank ceil(p * n) of the ordered values: an exact percentile that occurs in the data."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")


def violations(**rules: Column) -> Column:
    """The sorted names of rules that hold; rules are conditions of what is wrong."""
    return F.array_compact(F.array(*(F.when(rules[k], F.lit(k)) for k in sorted(rules))))


def key_violations(keys: Column, expected: list[str]) -> Column:
    """Missing and unknown keys of a closed record, each marked, sorted."""
    closed = F.array(*map(F.lit, expected))
    missing = F.transform(F.array_except(closed, keys), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.array_except(keys, closed), lambda k: F.concat(F.lit("unknown:"), k))
    return F.array_sort(F.concat(missing, unknown))


def compare_order(left: Column, right: Column) -> Column:
    """-1, 0 or 1 of two source orders, null where they can't be compared.

    Structs (provider, session_id, generation, event_index, timestamp_ms). Inside one session the
    event index decides; across sessions both trusted timestamps are needed.
    """
    same = (left["provider"] == right["provider"]) & (left["session_id"] == right["session_id"]) & (left["generation"] == right["generation"])
    by_index = F.signum(left["event_index"] - right["event_index"]).cast("int")
    key = lambda x: F.struct(x["timestamp_ms"], x["provider"], x["session_id"], x["generation"], x["event_index"])
    by_time = F.when(key(left) > key(right), 1).when(key(left) < key(right), -1).otherwise(0)
    return F.when(left.isNull() | right.isNull(), None).when(same, by_index).when(left["timestamp_ms"].isNotNull() & right["timestamp_ms"].isNotNull(), by_time)


def page_cursor(repo_key: Column, last_id: Column) -> Column:
    """An opaque page cursor: URL-safe base64 of a JSON object bound to its repository."""
    return F.rtrim(F.translate(F.base64(F.encode(canonical_json(after=last_id, repo=repo_key), "UTF-8")), "+/\r\n=", "-_"))


def repo_key(url: Column) -> Column:
    """owner/name of a remote URL, whether ssh or https, lower-cased, without .git."""
    tail = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/]+/|[^/@\s]+@[^:/\s]+:)(.+?)(?:\.git)?/*$", 1)
    return F.nullif(F.lower(tail), F.lit(""))


def safe_path(path: Column) -> Column:
    """A relative POSIX path without empty or dot parts; null if absolute, empty or going upwards."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    bad = path.startswith("/") | path.rlike(r"\\|^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def hmac_id(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, from its definition over the built-in digest."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)
