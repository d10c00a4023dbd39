"""References between skills, commands and agents, found in what their files say.

A mention is a name of the inventory as a word of its own: what stands beside it is neither a letter, a digit nor a hyphen or
underscore. All names are looked for at once by an automaton that is built once and sent to the tasks, if the names are within
``LIMIT_BYTES``; a larger inventory meets the words of the bodies in a join. An explicit reference is ``@name``, ``/name`` at a word's
start, or a path ``skills/name``, ``commands/name``, ``agents/name``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest inventory, in bytes of names, that is sent to the tasks.
LIMIT_BYTES = 8 << 20
EXPLICIT = r"(?:(?<![\w@/.-])[@/]|(?<![\w-])(?:skills|commands|agents)/)([a-z0-9]+(?:-[a-z0-9]+)*)(?![\w/-])"
IN_PATH = r"(?<![\w-])(?:skills|commands|agents)/([a-z0-9]+(?:-[a-z0-9]+)*)(?=/)"


def part_of_word(c: str) -> bool:
    return c.isalnum() or c in "-_"


def bounded(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] is a word of its own."""
    return (a == 0 or not part_of_word(text[a - 1])) and (b == len(text) or not part_of_word(text[b]))


def mentions(bodies: DataFrame, names: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(path, name): the names (name) that each body (path, body) mentions, whatever the case. Null names and bodies mention nothing."""
    low = names.where("name <> ''").select(F.lower("name").alias("name")).distinct()
    if (low.agg(F.sum(F.octet_length("name"))).first()[0] or 0) > limit_bytes:
        return joined_mentions(bodies, low)
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for r in low.toLocalIterator():
        automaton.add_word(r.name, r.name)
    automaton.make_automaton()
    sent, filled = bodies.sparkSession.sparkContext.broadcast(automaton), len(automaton) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = [], []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (body or "").lower()
                own = {n for end, n in sent.value.iter(text) if bounded(text, end + 1 - len(n), end + 1)} if filled else ()
                paths += [path] * len(own)
                found += sorted(own)
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "name": pa.array(found, pa.string())})

    return bodies.select("path", "body").mapInArrow(run, "path string, name string")


def joined_mentions(bodies: DataFrame, low: DataFrame) -> DataFrame:
    """The same for an inventory of any size: a name meets the bodies that have its first word, and those that have all of it stay."""
    word = r"[\p{L}\p{N}_-]+"
    first = F.regexp_extract("name", f"^[^\\p{{L}}\\p{{N}}_-]*({word})", 1)
    n = low.withColumn("first", first)
    b = bodies.where("body is not null").select("path", F.lower("body").alias("body"))
    words = b.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(f"({word})"), F.lit(1)))).alias("first"))
    met = words.join(n.where("first <> ''"), "first").select("path", "name")
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_-])\Q"), "name", F.lit(r"\E(?![\p{L}\p{N}_-])"))
    return met.join(b, "path").where(F.regexp_like("body", quoted)).select("path", "name")


def explicit(bodies: DataFrame) -> DataFrame:
    """(path, name): what each body refers to by ``@``, ``/`` or a path."""
    both = [F.regexp_extract_all("body", F.lit(p), F.lit(1)) for p in (EXPLICIT, IN_PATH)]
    return bodies.where("body is not null").select("path", F.explode(F.array_distinct(F.concat(*both))).alias("name"))


def dead_references(catalog: DataFrame) -> DataFrame:
    """(path, name): explicit references to what the inventory (path, name, body) doesn't have."""
    return explicit(catalog).join(catalog.select(F.lower("name").alias("name")).distinct(), "name", "left_anti").select("path", "name")


def unused_unreferenced(catalog: DataFrame, used: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(name): entries that nobody used (name) and that no other file mentions."""
    own = catalog.select(F.col("path").alias("own"), F.lower("name").alias("name"))
    said = mentions(catalog, catalog, limit_bytes).join(own, "name").where(F.col("path") != F.col("own")).select("name").distinct()
    return own.select("name").distinct().join(said, "name", "left_anti").join(used.select(F.lower("name").alias("name")).distinct(), "name", "left_anti")


def findings(catalog: DataFrame, used: DataFrame | None) -> DataFrame:
    """(category, target, tag, impact, path): the deterministic half of the coherence findings."""
    dead = dead_references(catalog).select(F.lit("dead-reference").alias("category"), F.col("name").alias("target"), F.lit("fix").alias("tag"), F.lit("high").alias("impact"), "path")
    if used is None:
        return dead
    idle = unused_unreferenced(catalog, used).join(catalog.select(F.lower("name").alias("name"), "path"), "name")
    return dead.unionAll(idle.select(F.lit("unused").alias("category"), F.col("name").alias("target"), F.lit("delete").alias("tag"), F.lit("low").alias("impact"), "path"))
