"""Text and feed analytics, where the two engines' functions differ in name: DataFrame plans beside their SQL."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.config import Config
from usagelens.functions import similar
from usagelens.functions.text import glob_pattern, normalised
from usagelens.operators.lineage import checkpoint

C = Config()
#: Texts of a block at most; two blocks' pairs are a task. A group of fewer is dealt to some blocks all the same, of so many texts at least.
BLOCK_TEXTS, FEW_BLOCKS, FEW_TEXTS = 24576, 6, 1000
#: Keys that a key's row of ``token_jaccard_pairs`` has of those before it.
KEYS_BEFORE = 4
Views = dict[str, DataFrame]


def settings(v: Views) -> Config:
    """The configuration of the views; that of plain frames is the default."""
    return getattr(v, "config", C)


def scan_typed_messages(v: Views) -> DataFrame:
    """A row for each block of a message, from payloads of two forms in one variant column: a user's text, or an array of content blocks."""
    block = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text")))
    data = F.when(F.col("role") == "user", F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct(block.alias("content"))))
    d = v["conversations"].select("conv_id", "turn", F.try_parse_json(data).alias("data"))
    return d.sparkSession.sql(
        """select conv_id, turn, cast(0 as bigint) block, try_variant_get(data, '$.text', 'string') text from {d} where try_variant_get(data, '$.content', 'variant') is null
    union all select conv_id, turn, cast(pos as bigint), try_variant_get(value, '$.text', 'string') from {d}, lateral variant_explode(try_variant_get(data, '$.content', 'variant'))""",
        d=d,
    )


#: Payloads of several types in one column, some broken, from the events.
MIXED = """case event_type
    when 'view' then concat('{"type":"step-finish","cost":', cast(cast(value as decimal(18,6)) as string), ',"tokens":{"input":', k, ',"cache":{"read":', 2 * k, '}}}')
    when 'click' then concat('{"type":"tool","tool":"t', k % 7, '","state":{"input":{"path":"f', k, '"},"status":"', case when k % 5 = 0 then 'error' else 'ok' end, '"}}')
    when 'signup' then concat('{"type":"text","text":"say ', k, '"}')
    when 'purchase' then concat('{"type":"step-finish","tokens":{"input":', k, '}}')
    else concat('{"type":"reasoning","text":', k) end"""


def mixed_payloads(v: Views) -> DataFrame:
    """Typed columns of payloads of any type; what can't be read is marked, not lost."""
    p = v["parts"].where("k is not null").withColumn("event_type", F.col("tool")).select("event_id", F.try_parse_json(F.expr(MIXED)).alias("data"))
    get = lambda path, kind="string": F.try_variant_get("data", path, kind)
    return p.select("event_id", F.col("data").isNotNull().alias("readable"), get("$.type").alias("kind"), F.round(get("$.cost", "double"), 6).alias("cost"), get("$.tokens.input", "long").alias("input_tokens"), get("$.tokens.cache.read", "long").alias("cache_read"), get("$.tool").alias("tool"), get("$.state.input.path").alias("path"), get("$.state.status").alias("status"), get("$.text").alias("said"))


def command_usage(v: Views) -> DataFrame:
    name = F.regexp_extract("url", r"^[a-z]+://[^/]+/([\w-]+)", 1)
    return v["pages"].select(name.alias("command")).where("command <> ''").groupBy("command").agg(F.count(F.lit(1)).alias("uses"))


def top5_commands(v: Views) -> DataFrame:
    return command_usage(v).orderBy(F.desc("uses"), "command").limit(5)


def prompt_groups(said: DataFrame, config: Config) -> DataFrame:
    """(session_id, key, preview, count, avg_chars) of prompts said again in a session: equal ones, then those whose first 100 characters are near an earlier one's.

    ``said`` has (session_id, text, at). In the order of ``at`` (nulls last) each prompt joins the earliest representative that is near, or else
    becomes one; the key is the representative's. Prompts of equal first characters always fare alike, so they are one node.
    """
    d = said.select("session_id", "at", F.length("text").alias("chars"), normalised("text").alias("prompt")).where(F.length("prompt") >= config.repeat_min_length)
    start = F.substring("prompt", 1, 100)
    first = F.min(F.struct(F.col("at").isNull().alias("late"), F.col("at"), F.md5("prompt").alias("own"), F.substring("prompt", 1, 80).alias("preview"))).alias("first")
    d = d.withColumns({"session": F.coalesce(F.concat(F.lit("="), F.col("session_id").cast("string")), F.lit("")), "prompt_start": start, "key": F.md5(start)})
    nodes = checkpoint(d.groupBy("session", "key").agg(F.first("session_id").alias("session_id"), F.first("prompt_start").alias("prompt"), first, F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")))
    place = nodes.select("session", "key", "first")
    # Numbers tell which prompt was first, but for equal ones; other kinds of ``at`` leave both orders.
    numbers = said.schema["at"].dataType.typeName() in ("byte", "short", "integer", "long")
    at = F.coalesce(F.col("first.at").cast("long"), F.lit(2**63 - 1)) if numbers else F.lit(0).cast("long")
    near = ratio_pairs(nodes.select("session", "key", "prompt", at.alias("low"), at.alias("high")), "session", config.near_duplicate).where("x <> y")
    near = near.join(place.withColumnsRenamed({"key": "x", "first": "x_first"}), ["session", "x"]).join(place.withColumnsRenamed({"key": "y", "first": "y_first"}), ["session", "y"])
    near = checkpoint(near.where("x_first < y_first").select("session", "x", "x_first", F.col("y").alias("key")))
    # A node with no earlier near one is a representative; its near ones aren't; then the same among the rest.
    left, chosen = checkpoint(nodes.select("session", "key")), None
    while not left.isEmpty():
        waiting = near.join(left.withColumnRenamed("key", "x"), ["session", "x"], "left_semi").select("session", "key")
        new = checkpoint(left.join(waiting, ["session", "key"], "left_anti"))
        chosen = new if chosen is None else checkpoint(chosen.unionAll(new))
        joined = near.join(new.withColumnRenamed("key", "x"), ["session", "x"], "left_semi").select("session", "key")
        left = checkpoint(left.join(new.unionAll(joined), ["session", "key"], "left_anti"))
    if chosen is None:
        chosen = left
    to = near.join(chosen.withColumnRenamed("key", "x"), ["session", "x"], "left_semi").groupBy("session", "key").agg(F.min("x_first").alias("to"))
    grouped = nodes.join(to, ["session", "key"], "left").withColumn("to", F.coalesce("to", "first"))
    out = grouped.groupBy("session_id", F.col("to.own").alias("key")).agg(F.min("to.preview").alias("preview"), F.sum("n").alias("count"), F.round(F.sum("chars") / F.sum("n"), 6).alias("avg_chars"))
    return out.where(F.col("count") >= config.repeat_min_count)


def user_prompt_repeats(v: Views) -> DataFrame:
    """Repeated prompts of a source, in the order of ids."""
    said = v["documents"].select(F.col("source").alias("session_id"), "text", F.col("doc_id").alias("at"))
    return prompt_groups(said, settings(v)).select(F.col("session_id").alias("source"), F.col("key").alias("prompt_key"), F.col("count").alias("n"))


def exact_prompt_repeats(v: Views) -> DataFrame:
    """The exact half of ``user_prompt_repeats``: groups of equal normalised prompts of a source."""
    d = v["documents"].select("source", normalised("text").alias("prompt")).where(F.length("prompt") >= settings(v).repeat_min_length)
    return d.groupBy("source", F.md5("prompt").alias("prompt_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= settings(v).repeat_min_count)


def repeats_cap(v: Views) -> DataFrame:
    return user_prompt_repeats(v).orderBy(F.desc("n"), "source", "prompt_key").limit(settings(v).repeats_cap)


def release_relevance(v: Views) -> DataFrame:
    hits = sum((F.col("text").rlike(rf"(?i)\b{k}\b").cast("int") for k in settings(v).keywords), F.lit(0))
    d = v["documents"].where("text is not null").select("doc_id", hits.cast("long").alias("hits"))
    return d.where("hits > 0").withColumn("relevance", F.when(F.col("hits") >= 2, "high").otherwise("medium"))


def summary_first_lines(v: Views) -> DataFrame:
    return v["documents"].where("text is not null").select("doc_id", F.substring_index("text", "\n", 2).alias("summary"))


def dedup_items(v: Views) -> DataFrame:
    d = v["documents"].where("text is not null").groupBy(F.md5(F.lower("text")).alias("item")).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("found_via"), F.count(F.lit(1)).alias("n"))
    return d


def notable_items(v: Views) -> DataFrame:
    """Items found by two sources or made in the window; an item's day is that of the order of its number."""
    c = settings(v)
    new = (F.col("o_orderdate") >= F.lit(c.month(0, 26)).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(c.month(-3, 26)).cast("timestamp_ntz"))
    made = v["orders"].where(new).select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("new"))
    d = v["documents"].where("text is not null").join(made, "doc_id", "left").groupBy(F.md5(F.lower("text")).alias("item"))
    return d.agg(F.countDistinct("source").alias("sources"), F.max(F.coalesce("new", F.lit(0))).alias("new")).select("item", "sources", (F.col("new") == 1).alias("new"), ((F.col("sources") >= 2) | (F.col("new") == 1)).alias("notable"))


def join_part_message_user(v: Views) -> DataFrame:
    """The text parts of users' messages: parts know their message, messages the role."""
    parts = v["conversations"].select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("part", "text"))
    users = v["conversations"].where("role = 'user'").select("conv_id", "turn", "role")
    return parts.join(users, ["conv_id", "turn"]).select("conv_id", "turn", F.col("part").cast("long").alias("part"), "role", "text")


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


def scan_watch_sources(v: Views) -> DataFrame:
    return links(v["pages"])


def link_diff(v: Views) -> DataFrame:
    now, before = links(v["pages"].where("page_id % 2 = 1")).select("link").distinct(), links(v["pages"].where("page_id % 2 = 0")).select("link").distinct()
    return now.join(before, "link", "left_anti")


def harness_projection(v: Views) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    p = v["pages"].select("page_id", path.alias("path"))
    allow = lambda globs: F.col("path").rlike("|".join(glob_pattern(g) for g in globs))
    return p.select("page_id", "path", allow(settings(v).projection["strict"]).alias("strict"), allow(settings(v).projection["advisory"]).alias("advisory"))


def token_jaccard_pairs(v: Views) -> DataFrame:
    """Pairs of documents of one language with token-set Jaccard of their whole texts at the threshold or more.

    Equal token sets are one node. Tokens are ranked rarest first by how many nodes of the language have them; a set's first
    ``n - ceil(n t) + 1`` tokens are its keys, so two sets at the threshold share one. Sets of whole texts are long, so a key's row has but the
    keys right before it: a pair that shares one of these as well leaves the join there, not here. What leaves it nevertheless more than once
    is made one, and the sets' words are fetched for the pairs left. Keys that one node alone has leave no row.
    """
    t = settings(v).similarity
    d = v["documents"].where("text is not null and lang is not null").select("doc_id", "lang", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("prompt"))
    d = d.select("doc_id", "lang", F.sort_array(F.array_distinct(F.split("prompt", " "))).alias("tokens"))
    d = d.withColumn("node", F.xxhash64("lang", "tokens"))
    nodes, d = checkpoint(d.select("node", "lang", "tokens").dropDuplicates(["node"])), checkpoint(d.select("doc_id", "node"))
    own = nodes.select("node", "lang", F.explode("tokens").alias("token")).select("node", F.xxhash64("lang", "token").alias("token"))
    ranked = own.join(own.groupBy("token").agg(F.count(F.lit(1)).alias("f")), "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("set"))
    most_keys = (F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).cast("int")
    sets = ranked.select("node", F.size("set").alias("n"), F.size(F.filter("set", lambda x: x["f"] == 1)).alias("alone"), F.col("set.token").alias("set"))
    sets = checkpoint(sets.select("node", "n", F.slice("set", F.col("alone") + 1, F.greatest(most_keys - F.col("alone"), F.lit(0))).alias("set"), "alone"))
    keys = sets.select("node", "n", "set", "alone", F.posexplode("set").alias("place", "token"))
    before = F.slice("set", F.greatest(F.col("place") + 1 - KEYS_BEFORE, F.lit(1)), F.least("place", F.lit(KEYS_BEFORE)))
    keys = keys.select("token", "node", "n", before.alias("before"), (F.col("place") + F.col("alone") + 1).alias("place"))
    x = keys.select("token", F.col("node").alias("x"), F.col("n").alias("p"), F.col("place").alias("i"), F.col("before").alias("xs"))
    y = keys.select("token", F.col("node").alias("y"), F.col("n").alias("q"), F.col("place").alias("j"), F.col("before").alias("ys"))
    near = (F.col("x") < F.col("y")) & (F.col("p") * t <= F.col("q") + 1e-9) & (F.col("q") * t <= F.col("p") + 1e-9)
    # So many tokens are shared at most when these are the first shared ones.
    most = F.least("i", "j") - 1 + F.least(F.col("p") - F.col("i"), F.col("q") - F.col("j")) + 1
    near &= most * (1 + t) >= (F.col("p") + F.col("q")) * t - 1e-9
    near &= ~F.arrays_overlap("xs", "ys")
    met = checkpoint(x.join(y, (x["token"] == y["token"]) & near).select("x", "y").distinct())
    a, b = nodes.select(F.col("node").alias("x"), F.col("tokens").alias("s")), nodes.select(F.col("node").alias("y"), F.col("tokens").alias("r"))
    both = F.size(F.array_intersect("s", "r"))
    similar = F.round(both / (F.size("s") + F.size("r") - both), 6)
    linked = checkpoint(met.join(a, "x").join(b, "y").withColumn("similarity", similar).where(F.col("similarity") >= t).select("x", "y", "similarity"))
    same = nodes.select(F.col("node").alias("x"), F.col("node").alias("y"), F.lit(1.0).alias("similarity"))
    either = linked.unionAll(linked.select(F.col("y").alias("x"), F.col("x").alias("y"), "similarity")).unionAll(same)
    left, right = d.select(F.col("doc_id").alias("a"), F.col("node").alias("x")), d.select(F.col("doc_id").alias("b"), F.col("node").alias("y"))
    return either.join(left, "x").join(right, "y").where("a < b").select("a", "b", "similarity")


def ratio_pairs(d: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, x, y, similarity): ordered pairs of texts of (group, key, prompt, low, high), by key, with a ratio at the threshold or more; a text with itself too.

    A key is its prompt's MD5. Only pairs whose y's high is at x's low or more are wanted. Texts of a group are dealt to blocks, and each two
    blocks meet in a task: no pair is left out and no task holds a group. A text is written as often as its group has blocks.
    """
    n = F.count(F.lit(1))
    blocks = d.groupBy(group).agg(F.greatest(F.ceil(n / BLOCK_TEXTS), F.least(F.ceil(n / FEW_TEXTS), F.lit(FEW_BLOCKS))).cast("int").alias("blocks"))
    own = d.join(F.broadcast(blocks), group).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    texts = (group, "prompt", "low", "high", "block")
    dealt = own.select(*texts, other).select(*texts, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    kind = d.schema[group].dataType.simpleString()

    def met(part: pa.Table) -> pa.Table:
        lo, hi = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        sides = [part.filter(pc.equal(part.column("block"), k)) for k in ((lo,) if lo == hi else (lo, hi))]
        texts = [t.column("prompt").to_pylist() for t in sides]
        spans = [np.stack([t.column(c).to_numpy() for c in ("low", "high")]) for t in sides]
        near = [(texts[0][i], texts[-1][j], r) if not turned else (texts[-1][j], texts[0][i], r) for i, j, turned, r in similar.tile(texts[0], texts[1] if lo != hi else None, threshold, spans)]
        got = [(*(hashlib.md5(t.encode(), usedforsecurity=False).hexdigest() for t in g[:2]), g[2]) for g in near]
        return pa.table({group: pa.array([part.column(group)[0].as_py()] * len(got), part.schema.field(group).type), "x": pa.array([g[0] for g in got], pa.string()), "y": pa.array([g[1] for g in got], pa.string()), "similarity": pa.array([g[2] for g in got], pa.float64())})

    # Tiles are small and take long: by number, they aren't put together by their bytes.
    tasks = 4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, group, "lo", "hi").groupBy(group, "lo", "hi").applyInArrow(met, f"{group} {kind}, x string, y string, similarity double")


def distinct_prompts(d: DataFrame, group: str) -> DataFrame:
    """The prompts of a group, of which a pair is wanted if the first one's document may be of the smaller id."""
    at = F.col("doc_id").cast("long")
    return d.where("doc_id is not null").groupBy(group, "key").agg(F.first("prompt").alias("prompt"), F.min(at).alias("low"), (F.max(at) - 1).alias("high"))


def similar_pairs_join(v: Views) -> DataFrame:
    """Sequence-ratio pairs within a language, the document of the smaller id first, over all pairs: equal texts are compared once."""
    d = v["documents"].select("doc_id", "lang", F.substring(normalised("text"), 1, 200).alias("prompt")).where("length(prompt) > 0 and lang is not null")
    # Whole texts are normalised once, not for each use of the prompts.
    d = checkpoint(d.withColumn("key", F.md5("prompt")))
    pairs = ratio_pairs(distinct_prompts(d, "lang"), "lang", settings(v).similarity)
    a, b = d.select("lang", F.col("doc_id").alias("a"), F.col("key").alias("x")), d.select("lang", F.col("doc_id").alias("b"), F.col("key").alias("y"))
    found = pairs.join(a, ["lang", "x"]).join(b, ["lang", "y"]).where("a < b")
    return found.select("a", "b", F.round("similarity", 6).alias("similarity")).where(F.col("similarity") >= settings(v).similarity)


def near_dup_prompt_join(v: Views) -> DataFrame:
    """Near-duplicate prompts (first 100 characters) within a source, over all pairs."""
    d = v["documents"].select("doc_id", "source", F.substring(normalised("text"), 1, 100).alias("prompt")).where("length(prompt) > 0 and source is not null")
    # Whole texts are normalised once, not for each use of the prompts.
    d = checkpoint(d.withColumn("key", F.md5("prompt")))
    pairs = ratio_pairs(distinct_prompts(d, "source"), "source", settings(v).near_duplicate)
    a, b = d.select("source", F.col("doc_id").alias("a"), F.col("key").alias("x")), d.select("source", F.col("doc_id").alias("b"), F.col("key").alias("y"))
    return pairs.join(a, ["source", "x"]).join(b, ["source", "y"]).where("a < b").select("source", "a", "b", F.round("similarity", 6).alias("similarity"))


def r3_merge(v: Views) -> DataFrame:
    """Pairs to merge: exact copies (each with the first of its group), and similar ones."""
    d = v["documents"].where("text is not null").select("doc_id", F.md5(F.lower("text")).alias("item"))
    first = d.groupBy("item").agg(F.min("doc_id").alias("a"))
    copies = d.join(first, "item").where("doc_id > a").select("a", F.col("doc_id").alias("b"), F.lit("duplicate").alias("reason"))
    similar_ = similar_pairs_join(v).select("a", "b", F.lit("similar").alias("reason")).join(copies.select("a", "b"), ["a", "b"], "left_anti")
    return copies.unionAll(similar_).withColumn("severity", F.lit("medium"))


def top_pairs(v: Views) -> DataFrame:
    return similar_pairs_join(v).orderBy(F.desc("similarity"), "a", "b").limit(settings(v).similar_pairs)


def prose_block_validation(v: Views) -> DataFrame:
    words = F.size(F.split(F.trim("text"), r"\s+")).cast("long")
    return v["documents"].where("text is not null and trim(text) <> ''").select("doc_id", words.alias("words"), F.col("text").rlike("[0-9]").alias("has_digits"))


def version_at_least(v: Views) -> DataFrame:
    parts = F.transform(F.split("s_version", r"\."), lambda x: x.cast("int"))
    d = v["supplier"].select("s_suppkey", F.concat((F.col("s_suppkey") % 9).cast("string"), F.lit("."), (F.col("s_suppkey") % 13).cast("string"), F.lit(".0")).alias("s_version"))
    return d.select("s_suppkey", "s_version", (parts >= F.array(F.lit(7), F.lit(9), F.lit(0))).alias("supported"))


NORM = "lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '[.!?,;: ]+$', '')))"
LINK = "select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) link from pages"
COMMANDS = "select command, count(*) uses from (select regexp_extract(url, '^[a-z]+://[^/]+/([\\w-]+)', 1) command from pages) c where command <> '' group by command"
REPEATS = f"select source, md5(prompt) prompt_key, count(*) n from (select source, {NORM} prompt from documents) p where length(prompt) >= {C.repeat_min_length} group by 1, 2 having count(*) >= {C.repeat_min_count}"
HITS = " + ".join(f"cast(regexp_matches(text, '(?i)\\b{k}\\b') as int)" for k in C.keywords)
SQL = {
    "scan_typed_messages": "select conv_id, turn, cast(0 as bigint) as block, text from conversations where role = 'user' union all select conv_id, turn, i - 1, b[i] from (select conv_id, turn, string_split(text, chr(10)) b, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from conversations where role is distinct from 'user') x",
    "command_usage": COMMANDS,
    "top5_commands": f"select * from ({COMMANDS}) c order by uses desc, command limit 5",
    "exact_prompt_repeats": REPEATS,
    "release_relevance": f"select doc_id, cast(hits as bigint) hits, case when hits >= 2 then 'high' else 'medium' end relevance from (select doc_id, {HITS} hits from documents where text is not null) h where hits > 0",
    "summary_first_lines": "select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)) summary from documents where text is not null",
    "dedup_items": "select md5(lower(text)) item, string_agg(distinct source, ',' order by source) found_via, count(*) n from documents where text is not null group by 1",
    "notable_items": f"select md5(lower(text)) item, count(distinct source) sources, bool_or(doc_id in (select o_orderkey from orders where o_orderdate >= timestamp '{C.month(0, 26)}' and o_orderdate < timestamp '{C.month(-3, 26)}')) as new, count(distinct source) >= 2 or bool_or(doc_id in (select o_orderkey from orders where o_orderdate >= timestamp '{C.month(0, 26)}' and o_orderdate < timestamp '{C.month(-3, 26)}')) notable from documents where text is not null group by 1",
    "join_part_message_user": "select conv_id, turn, i - 1 as part, role, b[i] as text from (select conv_id, turn, role, string_split(text, chr(10)) b, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from conversations where role = 'user') x",
    "scan_watch_sources": LINK,
    "link_diff": f"select distinct link from ({LINK}) x where page_id % 2 = 1 and link not in (select link from ({LINK}) y where page_id % 2 = 0)",
    "harness_projection": "select page_id, path, path like '/en/%' strict, path like '/en/%' or path like '/fr/%' advisory from (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path from pages) p",
    "token_jaccard_pairs": f"""with d as (select doc_id, lang, list_distinct(string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) t from documents where text is not null and lang is not null),
p as (select a.doc_id a, b.doc_id b, len(list_intersect(a.t, b.t)) i, len(a.t) x, len(b.t) y from d a join d b on a.lang = b.lang and a.doc_id < b.doc_id and len(a.t) * {C.similarity} <= len(b.t) and len(b.t) * {C.similarity} <= len(a.t))
select a, b, round(i / (x + y - i), 6) similarity from p where round(i / (x + y - i), 6) >= {C.similarity}""",
    "prose_block_validation": "select doc_id, cast(len(regexp_split_to_array(trim(text), '\\s+')) as bigint) words, regexp_matches(text, '[0-9]') has_digits from documents where text is not null and trim(text) <> ''",
    "version_at_least": "select s_suppkey, v s_version, (a, b, 0) >= (7, 9, 0) supported from (select s_suppkey, s_suppkey % 9 a, s_suppkey % 13 b, (s_suppkey % 9) || '.' || (s_suppkey % 13) || '.0' v from supplier) x",
}
PLANS = {f.__name__: f for f in (scan_typed_messages, mixed_payloads, command_usage, top5_commands, user_prompt_repeats, exact_prompt_repeats, repeats_cap, r3_merge, release_relevance, summary_first_lines, dedup_items, notable_items, join_part_message_user, scan_watch_sources, link_diff, harness_projection, token_jaccard_pairs, similar_pairs_join, near_dup_prompt_join, top_pairs, prose_block_validation, version_at_least)}
