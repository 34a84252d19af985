"""Results as text for an agent. All of it runs over results, tens of rows a group, not over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import excerpt, strip
from recollect.model import ALWAYS_KEPT_TYPES

# Headings and limits of the formats.
NOTHING = "No memories found matching your query."
RELATED, CONFLICTS = "--- Related (via graph) ---\n", "--- Conflicting context ---\n"
SHOWN, SHOWN_IN_SECTION, NEARBY, SHORT_ID = 200, 300, 10, 8
NO_PROJECT = "No project-specific memories yet.\n"


def heading(node: str = "") -> Column:
    """The title, or the beginning of the content."""
    title, content = F.col(f"{node}title"), F.coalesce(F.col(f"{node}content"), F.lit(""))
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(excerpt(strip(content)))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _lines(*parts: Column) -> Column:
    """The parts that are not null, each on a line of its own."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _short(content: Column, most: int = SHOWN) -> Column:
    text = strip(F.coalesce(content, F.lit("")))
    return F.when(text != "", F.concat(F.lit("   "), F.substring(text, 1, most), F.when(F.length(text) > most, "...").otherwise("")))


def search_results(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """(prompt_id, text) for all prompts (prompt_id), from results with their node's columns.

    Results are prompt_id, score, source, activated_by, activation_edge, id, type, tier, title, content, created.
    Direct hits come first, then what they activated, then what contradicts them, each by score, then id.
    """
    section = F.when(F.col("source") == "activated", 1).when(F.col("source") == "conflict", 2).otherwise(0)
    score, seed = F.format_string("%.3f", F.col("score")), F.concat(F.substring(_text(F.col("activated_by")), 1, SHORT_ID), F.lit("..."))
    about = (
        F.when(F.col("section") == 0, F.concat(F.lit(" | Tier: "), "tier", F.lit(" | Score: "), score, F.lit(" | Created: "), F.coalesce(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))))
        .when(F.col("section") == 1, F.concat(F.lit(" | Score: "), score, F.lit(" | via "), F.coalesce("activation_edge", F.lit("related_to")), F.lit(" from "), seed))
        .otherwise(F.concat(F.lit(" | Score: "), score, F.lit(" | contradicts "), seed))
    )
    body = _lines(F.concat(F.lit("   ID: "), F.col("id").cast("string"), about), _short(F.col("content")), F.lit(""))
    rows = results.withColumn("section", section).select("prompt_id", "section", "score", "id", F.concat(F.lit(". ["), "type", F.lit("] "), heading(), F.lit("\n"), body).alias("entry"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "entry"))), lambda x: x["entry"])
    numbered = F.transform(listed, lambda e, i: F.concat((i + 1).cast("string"), e))
    sections = rows.groupBy("prompt_id", "section").agg(numbered.alias("entries"))
    by = F.map_from_entries(F.collect_list(F.struct("section", "entries")))
    some = lambda k: F.coalesce(F.element_at("m", F.lit(k)), F.array().cast("array<string>"))
    each = sections.groupBy("prompt_id").agg(by.alias("m")).select("prompt_id", some(0).alias("direct"), some(1).alias("related"), some(2).alias("clash"))
    extra = F.size("related") + F.size("clash")
    head = F.concat(F.lit("Found "), F.size("direct").cast("string"), F.lit(" memories"), F.when(extra > 0, F.concat(F.lit(" (+"), extra.cast("string"), F.lit(" related)"))).otherwise(""), F.lit(":\n"))
    under = lambda title, c: F.when(F.size(c) > 0, F.concat(F.array(F.lit(title)), F.col(c))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(head), F.col("direct"), under(RELATED, "related"), under(CONFLICTS, "clash")), "\n")
    return prompts.select("prompt_id").distinct().join(each.select("prompt_id", whole.alias("text")), "prompt_id", "left").fillna(NOTHING, ["text"])


def node_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, text): each node with its edges, and up to ten of the nodes at their other ends.

    Edges stand by the other's id and type; an edge without the other node is listed, but no nearby memory.
    """
    ids = nodes.select("id")
    ends = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "edge_type", "weight", F.lit("→").alias("way"))
    ends = ends.union(edges.where("source_id != target_id").select("target_id", "source_id", "edge_type", "weight", F.lit("←"))).join(ids, "id", "left_semi")
    line = F.concat(F.lit("  "), "way", F.lit(" "), "edge_type", F.lit(" ("), F.format_string("%.1f", F.col("weight")), F.lit(") "), F.col("other").cast("string"))
    near = F.concat(F.lit("- ["), "type", F.lit("] "), heading(), F.lit(" (id: "), F.substring(F.col("other").cast("string"), 1, SHORT_ID), F.lit("...)"))
    named = ends.join(nodes.select(F.col("id").alias("other"), "type", "title", "content"), "other", "left")
    order = lambda x: F.array_sort(F.collect_list(F.struct("other", "edge_type", x.alias("t"))))
    nearby = F.array_sort(F.collect_set(F.when(F.col("type").isNotNull(), F.struct("other", near.alias("t")))))
    listed = named.groupBy("id").agg(F.transform(order(line), lambda x: x["t"]).alias("edges"), F.transform(F.slice(nearby, 1, NEARBY), lambda x: x["t"]).alias("near"))
    block = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(c, "\n")))
    content = strip(F.coalesce("content", F.lit("")))
    text = _lines(
        F.concat(F.lit("## ["), "type", F.lit("] "), heading()), F.concat(F.lit("ID: "), F.col("id").cast("string")),
        F.concat(F.lit("Tier: "), "tier", F.lit(" | Space: "), F.when(F.coalesce("space", F.lit("")) != "", F.col("space")).otherwise("unassigned")),
        F.when(content != "", F.concat(F.lit("\n"), content)), block("### Connections", "edges"), block("---\n### Nearby Memories", "near"),
    )
    return nodes.join(listed, "id", "left").select("id", text.alias("text"))


def section(rows: DataFrame, title: str, prefix: str = "#", with_ids: bool = False, most: int = SHOWN_IN_SECTION, empty: str | None = None) -> DataFrame:
    """One row (text): a heading and the rows (place, id, type, title, content) in order; `empty` stands for none."""
    content = strip(F.coalesce("content", F.lit("")))
    mark = F.concat(F.lit(" (id: "), F.substring(F.col("id").cast("string"), 1, SHORT_ID), F.lit(")")) if with_ids else F.lit("")
    entry = _lines(F.concat(F.lit("- **["), "type", F.lit("]** "), heading(), mark), F.when((content != "") & (content != heading()), F.concat(F.lit("  "), F.substring(content, 1, most))), F.lit(""))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "id", entry.alias("t")))), lambda x: x["t"])
    top = F.array(F.lit(f"{prefix} {title}\n"))
    return rows.agg(listed.alias("l")).select(F.array_join(F.concat(top, F.when(F.size("l") > 0, F.col("l")).otherwise(F.array(F.lit(empty)) if empty else F.array().cast("array<string>"))), "\n").alias("text"))


def kept_identities(identities: DataFrame, scores: DataFrame, most: int = 10) -> DataFrame:
    """Persons and preferences among identity nodes, and of the others the best by hint score (id, score) up to `most`."""
    always = identities.where(F.col("type").isin(*ALWAYS_KEPT_TYPES))
    rest = identities.where(~F.col("type").isin(*ALWAYS_KEPT_TYPES)).join(scores.select("id", "score"), "id", "left").orderBy(F.desc_nulls_last("score"), "id").limit(most)
    room = always.agg(F.greatest(F.lit(most) - F.count("*"), F.lit(0)).alias("_room"))
    numbered = rest.withColumn("_n", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "id")))  # `most` rows
    return always.unionByName(numbered.join(F.broadcast(room), F.col("_n") <= F.col("_room")).select(*identities.columns))


def unprocessed(nodes: DataFrame, edges: DataFrame, now: Column, threshold: int, hours: int = 24) -> DataFrame:
    """One row (unprocessed_memories), if more than `threshold` nodes of the last hours start no edge; else none."""
    young = nodes.where(F.col("created") >= F.timestamp_seconds(now.cast("bigint") - hours * 3600))
    free = young.join(edges.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    return free.agg(F.count("*").alias("unprocessed_memories")).where(F.col("unprocessed_memories") > threshold)
