"""Recall for a message: entities, concepts, similarity and the project weigh nodes; the best are loaded within a budget."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.checkpoints import settled
from ..sources.graph import current
from .search import concept_hits, hit_count

#: Weights, the least similarity, the least score with and without a project, and the budget.
KEYWORD, SEMANTIC, CONCEPT, CONTEXT = 0.3, 0.5, 0.4, 0.2
LEAST_COSINE = 0.6
LEAST_IN_PROJECT, LEAST_ANYWHERE = 0.1, 0.2
LOADED, HINTS, BUDGET = 5, 15, 3000
#: Words after which a subject is named, and words that are no concept.
LEADS = ("about", "on", "for", "with", "using", "fix", "debug", "build", "create", "find")
NO_CONCEPT = frozenset("the is a an to of in for on with and or but it this that how what why can do be are was were will".split())


def entities(message: str) -> list[str]:
    """Capitalised words inside a sentence, words after a lead, and the message itself, each once."""
    names = [m.group() for m in re.finditer(r"\b[A-Z][a-z]+\b", message) if m.start() and not re.search(r"\.\s+$", message[: m.start()])]
    subjects = re.findall(rf"\b(?:{'|'.join(LEADS)})\s+([a-zA-Z0-9_-]+)\b", message, re.IGNORECASE)
    return list(dict.fromkeys([*names, *subjects, message]))


def concepts(message: str) -> list[str]:
    """Words of three letters or more that may name a concept, each once."""
    return list(dict.fromkeys(w for w in re.sub(r"[^a-z0-9_ ]", " ", message.lower()).split() if len(w) > 2 and w not in NO_CONCEPT))


def entry(nodes: DataFrame) -> Column:
    """How a node is shown when it is loaded; its length counts against the budget."""
    return F.concat(F.lit("["), "id", F.lit("] "), "label", F.lit(" ("), "type", F.lit(") "), F.coalesce("essence", F.lit("")), F.lit(" / "), F.array_join("concepts", ", "))


def scored(nodes: DataFrame, message: str, similar: DataFrame, derived: DataFrame, edges: DataFrame, project: str | None = None, active: Sequence[str] = ()) -> DataFrame:
    """Nodes with a score for the message: id, score, reasons and entry.

    similar: id, similarity. derived: id of nodes that were derived. edges join nodes to the project. An empty message finds
    nothing by words. Nodes of unknown quality count as of quality 3.
    """
    text = F.concat_ws("\n", F.lower("label"), F.lower("essence"))
    asked = [t.lower() for t in entities(message) if t.strip()]
    wanted = concepts(message)
    word = hit_count(text, asked) * KEYWORD
    near = similar.filter(F.col("similarity") > LEAST_COSINE).select("id", (F.col("similarity") * SEMANTIC).alias("near"))
    ideas = concept_hits(nodes, wanted).select("id", (F.least(F.col("matched") * 0.2, F.lit(0.8)) * CONCEPT).alias("idea")) if wanted else nodes.select("id", F.lit(0.0).alias("idea")).limit(0)
    rows = nodes.withColumn("word", word.cast("double")).join(near, "id", "left").join(ideas, "id", "left").join(derived.select("id").distinct().withColumn("was_derived", F.lit(True)), "id", "left").na.fill(0.0, ["near", "idea"])
    base = F.col("word") + F.col("near") + F.col("idea")
    context = F.lit(0.0)
    if project:
        held = current(edges).filter((F.col("source_id") == project) | (F.col("target_id") == project))
        kin = held.select(F.when(F.col("source_id") == project, F.col("target_id")).otherwise(F.col("source_id")).alias("id")).distinct().withColumn("kin", F.lit(True))
        rows = rows.join(kin, "id", "left")
        outside = F.when((base > 0) & ~F.col("type").isin("process", "skill"), base * 0.85).otherwise(base)
        own = F.when(F.col("project_id") == project, CONTEXT).otherwise(0.0)
        context = F.when(F.col("id") == project, CONTEXT * 2).when(F.col("kin"), CONTEXT * 1.2).otherwise(0.0) + own
        base = F.when((F.col("id") == project) | F.col("kin"), base).otherwise(outside)
    used = F.when(F.col("id").isin(*active), CONTEXT).otherwise(0.0) if active else F.lit(0.0)
    found = rows.withColumn("context", context).withColumn("used", used).withColumn("total", base + F.col("context") + F.col("used")).filter("total > 0 AND NOT startswith(label, 'agent_session_')")
    more = F.when(F.col("was_derived"), 0.15).otherwise(0.0) + F.when(F.col("type") == "insight", 0.1).otherwise(0.0)
    weight = F.when(F.col("quality") > 0, F.col("quality")).otherwise(3) / 6
    why = F.concat_ws(",", *(F.when(F.col(c) > 0, F.lit(n)) for c, n in (("word", "keyword"), ("near", "semantic"), ("idea", "concept"), ("context", "context"), ("used", "active_session"))))
    return found.select("id", F.round((F.col("total") + more) * weight, 6).alias("score"), why.alias("reasons"), entry(nodes).alias("entry"))


def auto_recall(nodes: DataFrame, message: str, similar: DataFrame, derived: DataFrame, edges: DataFrame, project: str | None = None, active: Sequence[str] = ()) -> DataFrame:
    """The nodes that a message recalls, best first (equal scores by id): id, place, score, reasons and shown.

    Loaded are, in this order, the first LOADED that still fit into BUDGET characters; the first HINTS of the others are
    hints. A node that doesn't fit is passed over for good, since the budget only shrinks.
    """
    least = LEAST_IN_PROJECT if project else LEAST_ANYWHERE
    ranked = settled(scored(nodes, message, similar, derived, edges, project, active).filter(F.col("score") >= least).withColumn("chars", F.length("entry")).drop("entry"))
    loaded, room, after = [], BUDGET, F.lit(True)
    while len(loaded) < LOADED:
        best = ranked.filter(after & (F.col("chars") < room)).orderBy(F.desc("score"), "id").select("id", "score", "chars").head()
        if best is None:
            break
        loaded.append(best.id)
        room -= best.chars
        after = (F.col("score") < best.score) | ((F.col("score") == best.score) & (F.col("id") > best.id))
    is_loaded = F.col("id").isin(*loaded) if loaded else F.lit(False)
    shown = ranked.filter(is_loaded).withColumn("shown", F.lit("loaded"))
    hints = ranked.filter(~is_loaded).orderBy(F.desc("score"), "id").limit(HINTS).withColumn("shown", F.lit("hint"))
    both = shown.unionByName(hints)
    # at most LOADED + HINTS rows
    return both.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint")).select("id", "place", "score", "reasons", "shown")
