"""The few functions that need Python: Arrow-batched pandas UDFs."""

from __future__ import annotations

import hashlib
import shlex
import unicodedata
from pathlib import PurePath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.functions.columns import PREFIX_SEED

# Commands that check a repository, by the words that must follow them (none: always).
ALWAYS = ("pytest", "mypy", "tox", "nox", "gradle", "gradlew", "mvn", "mvnw")
FIRST_WORD = {"ruff": ("check", "format"), "cargo": ("build", "check", "test"), "go": ("build", "test", "vet")}
ANY_WORD = {"make": ("check", "ci", "lint", "test")}
PACKAGE_RUNNERS = ("npm", "pnpm", "yarn", "bun")
RUNNER_SCRIPTS = ("build", "test")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composed form; text that is ASCII is left as it is."""
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def command_words(command: str | None) -> list[str] | None:
    """Shell words without a leading ``uv run``; null where quotes don't close."""
    if command is None:
        return None
    try:
        found = shlex.split(command)
    except ValueError:
        return None
    return found[2:] if found[:2] == ["uv", "run"] else found


def check_name(command: str | None) -> str | None:
    """The checking program's name if the command verifies a repository, else null."""
    found = command_words(command)
    if not found:
        return None
    name, rest = PurePath(found[0]).name, found[1:]
    if name in ALWAYS:
        return name
    if name in PACKAGE_RUNNERS:
        runs = rest[:1] == ["test"] or (rest[:1] == ["run"] and rest[1:2] and rest[1] in RUNNER_SCRIPTS)
        return name if runs else None
    if name in FIRST_WORD:
        return name if rest and rest[0] in FIRST_WORD[name] else None
    return name if set(rest) & set(ANY_WORD.get(name, ())) else None


#: Programs that read the files they name, and shells that run a script. Of each program the options that take a value.
READERS = {"cat": (), "head": ("-n", "-c", "--lines", "--bytes"), "tail": ("-n", "-c", "--lines", "--bytes"), "sed": ("-e", "-f", "--expression", "--file")}
SHELLS = ("bash", "sh", "zsh")
_ENDS = frozenset(";\n|&()")


def _simple_commands(script: str) -> list[tuple[list[str], list[str]]]:
    """The simple commands of a script, each with the files that are redirected into it; empty where quotes don't close."""
    lexer = shlex.shlex(script, posix=True, punctuation_chars=";\n|&()<>")
    lexer.whitespace, lexer.whitespace_split, lexer.commenters = " \t\r", True, ""
    try:
        found = list(lexer)
    except ValueError:
        return []
    out: list[tuple[list[str], list[str]]] = [([], [])]
    redirect = ""
    for token in found:
        if token and set(token) <= _ENDS | set("<>"):
            redirect = token if set(token) & set("<>") else ""
            if redirect and out[-1][0] and out[-1][0][-1].isdigit():
                out[-1][0].pop()  # the number of a redirected stream
            if not redirect:
                out.append(([], []))
        elif redirect:
            if redirect == "<":
                out[-1][1].append(token)
            redirect = ""
        else:
            out[-1][0].append(token)
    return out


def read_paths(command: str | None) -> list[str] | None:
    """The files that a command line reads by cat, head, tail or sed, in order: in pipes, lists and scripts given to a shell, and by redirection. Null of null."""
    if command is None:
        return None
    paths: list[str] = []
    for words, redirected in _simple_commands(command):
        while words and "=" in words[0] and words[0].split("=")[0].isidentifier():
            words = words[1:]
        if not words:
            continue
        name, rest = PurePath(words[0]).name, words[1:]
        if name in SHELLS and "-lc" in rest or name in SHELLS and "-c" in rest:
            at = rest.index("-lc" if "-lc" in rest else "-c") + 1
            paths += read_paths(rest[at]) if at < len(rest) else []
        elif name in READERS:
            named, script, i = [], name == "sed", 0
            while i < len(rest):
                word = rest[i]
                if word == "--":
                    named += rest[i + 1 :]
                    break
                if word in READERS[name]:
                    script, i = False, i + 1
                elif word.startswith("--expression=") or word.startswith("--file="):
                    script = False
                elif word != "-" and not word.startswith("-"):
                    named.append(word)
                i += 1
            paths += (named[1:] if script else named) + redirected
    return paths


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_reads(commands: pd.Series) -> pd.Series:
    """read_paths of each command; each distinct command is read once."""
    known = {c: read_paths(c) for c in commands.dropna().unique()}
    return commands.map(lambda c: known.get(c))


@F.pandas_udf(T.StringType())
def verification(commands: pd.Series) -> pd.Series:
    """check_name of each command; each distinct command is read once."""
    known = {c: check_name(c) for c in commands.dropna().unique()}
    return commands.map(known).astype(object).where(commands.notna(), None)


def evidence(facts: list[dict], limit: int) -> list[str]:
    """Ids of the facts that stand for an episode, in order of place: the opening, then by priority, each with the fact that it refers to.

    facts: at (event_index, fact_ordinal), priority, opening, fact_id, and needs, the id of the
    fact that it refers to or null. A fact that no longer fits with what it needs is passed over.
    """
    chosen: set[str] = set()
    order = sorted(facts, key=lambda f: (f["priority"], f["at"]["event_index"], f["at"]["fact_ordinal"]))
    known = {f["fact_id"] for f in facts}
    for f in [*(f for f in order if f["opening"]), *order]:
        if len(chosen) == limit:
            break
        with_it = {f["fact_id"], *([f["needs"]] if f["needs"] in known else [])} - chosen
        if f["fact_id"] not in chosen and len(chosen) + len(with_it) <= limit:
            chosen |= with_it
    return [f["fact_id"] for f in sorted(facts, key=lambda f: (f["at"]["event_index"], f["at"]["fact_ordinal"])) if f["fact_id"] in chosen]


def evidence_column(limit: int):
    """A function of an array column of facts: evidence of each row."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chosen(facts: pd.Series) -> pd.Series:
        return facts.map(lambda rows: None if rows is None else evidence(list(rows), limit))

    return chosen


def next_prefix(prefix: bytes, digest: str) -> bytes:
    """The prefix hash after one more record."""
    return hashlib.sha256(prefix + bytes.fromhex(digest)).digest()


def prefixes_at(records: DataFrame, ends: DataFrame) -> DataFrame:
    """The prefix hash of each key's records before each of its ends: (key, place, prefix_sha256), a row for each end.

    records: (key, place, digest); a place that occurs several times, as blocks of one record do, is
    folded once, with its least digest. ends: (key, place). A key is read once, in order, whatever the
    number of its ends; rows are sorted on disk, so a task holds one batch and one hash.
    """
    rows = records.select("key", "place", F.lit(True).alias("record"), "digest").unionByName(ends.select("key", "place", F.lit(False).alias("record"), F.lit("").alias("digest")))
    kind = rows.schema["key"].dataType.simpleString()

    def fold(batches):
        key, last, prefix = None, None, b""
        for batch in batches:
            out = []
            for i, (own, place, record, digest) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if last is None or own != key:
                    key, last, prefix = own, -1, hashlib.sha256(PREFIX_SEED.encode()).digest()
                if not record:
                    out.append((i, prefix.hex()))
                elif place != last:
                    prefix, last = next_prefix(prefix, digest), place
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([h for _, h in out], pa.string())], names=["key", "place", "prefix_sha256"])

    # An end stands before the record of its place. Keys are dealt out by their hash: where both sides are grouped by key already, Spark 4.1
    # leaves out a repartition by the key itself, and then coalesces the sides' partitions each in its own way.
    rows = rows.where("place is not null and digest is not null").withColumn("place", F.col("place").cast("long"))
    ordered = rows.repartition(F.xxhash64("key")).sortWithinPartitions("key", "place", "record", "digest")
    return ordered.mapInArrow(fold, f"key {kind}, place long, prefix_sha256 string")
