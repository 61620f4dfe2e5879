"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Method. Tokens are summed per cell (source, language, topic). The cells' weights are raked: in turn, each of the three
marginals is scaled to its target, ``ROUNDS`` times over. A document's sampling probability is its cell's factor
(raked over present tokens) times ``rate``; a hash of its id decides.

Bounds. No document is drawn with more than certainty, so a cell's factor is at most 1 / ``rate``. A level is asked for
at most ``ROOM`` of its tokens (all if the rate is higher); what a target asks beyond that goes to the other levels in
proportion. In each step cells at the bound stay there and the rest of the level is scaled to what is left of its
target. So the sample has the stated rate at every size of input, and rare levels gain as far as they can, without
deciding how much of the others is kept. ``misses`` reports every level's share that was asked for, the share after
the bounds, and the share reached. With ``repeats`` there are no bounds: a document comes floor(p) times and once more
by its hash, and ``probability`` is the expected number of copies.

Targets of a marginal are either given weights per level or a power of the present shares (below 1: rare levels gain).
Levels without a given weight get none.

Scale. One scan sums tokens with a combine before the shuffle; raking works on the cell table alone. The targets are
joined to it once. Up to ``FEW_CELLS`` cells are one partition, in which a level's sums are windows, without shuffles or
joins, and ``STRETCH`` rounds are written at a time; more are summed and joined by Spark, and each round is written. So
the driver holds few and small plans. Documents meet their cell's factor by
a broadcast behind a row check, else by a join. No document is moved in the first case.

Defined cases: null source, language or text count as levels of their own ('' for source and language, topic ``none``)
or as no tokens; documents in a cell without tokens get the probability ``rate`` as given; null ids share one draw, as equal
ids do; an empty table gives an empty result; all other columns, whatever their names, are kept, but for the four added
ones, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spectraloom.llm.common import Scratch, small_side

ROUNDS = 12
RATE = 0.7
ROOM = 0.85    # of a level's tokens that a target may ask for
SETTLED = 1e-14  # of a cell's tokens: a round that moves no cell by more is the last
STRETCH = 4    # rounds between two looks at whether the cells have settled
FEW_CELLS = 20_000  # up to so many cells a round needs no shuffle
FILLS = 8      # steps at most in which what levels cannot give is dealt to the others
POWER = 0.7
SEED = "mix"
#: Topics by the first substring that a text contains; else prose.
TOPICS = [("table", " | "), ("licence", "icense"), ("contact", "@"), ("shout", "!! ")]
WORD = "[^\\x20\\x09-\\x0D]+"
AXES = ["source", "lang", "topic"]


def topic_of(text: Column, rules=tuple(TOPICS)) -> Column:
    found = F.when(text.isNull(), "none")
    for name, part in rules:
        found = found.when(F.contains(text, F.lit(part)), name)
    return found.otherwise("prose")


def draw(ident: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the id only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(ident.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def weights_of(cells: DataFrame, axis: str, target: float | dict) -> DataFrame:
    """(axis, present, weight): tokens and the weight asked for of every level."""
    levels = cells.groupBy(axis).agg(F.sum("tokens").alias("present"))
    if isinstance(target, dict):
        given = F.create_map(*[F.lit(x) for pair in target.items() for x in pair]) if target else F.lit(None)
        weight = F.coalesce(F.element_at(given, F.col(axis)).cast("double"), F.lit(0.0)) if target else F.lit(0.0)
    else:
        weight = F.pow("present", F.lit(float(target)))
    return levels.withColumn("weight", weight)


def filled(levels: DataFrame, total: float, room: float | None) -> Column:
    """Targets that add up to ``total``: a common multiple of the weights, at most ``room`` of what is present."""
    asked = float(levels.agg(F.sum("weight")).first()[0] or 0.0)
    scale = total / asked if asked else 0.0
    for _ in range(FILLS if room else 0):  # sums only: the levels stay where they are
        over = F.col("weight") * scale >= F.col("present") * room
        given, left = levels.agg(F.sum(F.when(over, F.col("present") * room).otherwise(0.0)),
                                 F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not left:
            break
        new = (total - given) / left
        if new == scale:
            break
        scale = new
    target = F.col("weight") * scale
    return F.least(target, F.col("present") * room) if room else target


def targets_of(cells: DataFrame, scratch: Scratch, targets: dict, rate: float, repeats: bool) -> dict:
    """By axis: (axis, asked, target), tokens before and after the bounds; the targets of all axes have one sum."""
    room = None if repeats else max(ROOM, rate) / rate
    levels = {axis: scratch.keep(weights_of(cells, axis, targets[axis]), f"levels-{axis}") for axis in AXES}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0.0)
    can = [float(x.where("weight > 0").agg(F.sum("present")).first()[0] or 0.0) * room for x in levels.values()] if room else []
    goal = min([total, *can])
    return {axis: scratch.keep(x.select(axis, filled(x, total, None).alias("asked"), filled(x, goal, room).alias("target")),
                               f"target-{axis}") for axis, x in levels.items()}


def rake(cells: DataFrame, scratch: Scratch, goals: dict, rounds: int = ROUNDS, most: float | None = None) -> DataFrame:
    """The cells (axes, tokens) with ``raked`` tokens, at most ``most`` times the tokens."""
    bound = F.lit(float("inf")) if most is None else F.col("tokens") * most
    few = cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    raked = cells.withColumns({"raked": F.col("tokens"), "before": F.col("tokens")})
    for axis in AXES:
        raked = raked.join(goals[axis].select(axis, F.col("target").alias(f"target_{axis}")), axis, "left")
    raked = scratch.keep(raked, "raked")
    for start in range(0, rounds, STRETCH):
        raked = raked.coalesce(1) if few else raked
        for _ in range(start, min(start + STRETCH, rounds)):
            raked = raked.withColumn("before", F.col("raked"))
            for axis in AXES:
                sums = {"now": F.sum("raked"), "full": F.sum(F.when(F.col("raked") >= bound, F.col("raked")).otherwise(0.0))}
                if few:
                    raked = raked.withColumns({k: v.over(Window.partitionBy(axis)) for k, v in sums.items()})
                else:
                    raked = raked.join(raked.groupBy(axis).agg(*[v.alias(k) for k, v in sums.items()]), axis)
                now, full, target = F.col("now"), F.col("full"), F.col(f"target_{axis}")
                factor = (F.when((target > now) & (now > full), (target - full) / (now - full))
                          .when(now > 0, target / now).otherwise(0.0))
                raked = raked.where(target.isNotNull()).withColumn(
                    "raked", F.least(F.col("raked") * factor, bound)).drop(*sums)
            if not few:
                raked = scratch.keep(raked, "raked")
        raked = scratch.keep(raked, "raked") if few else raked
        if not raked.where(F.abs(F.col("raked") - F.col("before")) > SETTLED * F.col("tokens")).limit(1).count():
            break
    return raked.select(*AXES, "tokens", "raked")


def cells_of(plain: DataFrame) -> DataFrame:
    return plain.groupBy(*AXES).agg(F.sum("n_tokens").cast("double").alias("tokens")).where("tokens > 0")


def misses(docs: DataFrame, targets: dict | None = None, rate: float = RATE, rounds: int = ROUNDS,
           text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
           repeats: bool = False) -> DataFrame:
    """(axis, level, asked, target, reached): shares of the expected sample, before and after the bounds and reached."""
    scratch = Scratch(docs.sparkSession, "mixing")
    cells = scratch.keep(cells_of(levelled(docs, text_col, source_col, lang_col, topic)), "cells")
    goals = targets_of(cells, scratch, {axis: POWER for axis in AXES} | (targets or {}), rate, repeats)
    raked = rake(cells, scratch, goals, rounds, None if repeats else 1 / rate)
    total = float(raked.agg(F.sum("raked")).first()[0] or 0.0)
    found = []
    for axis in AXES:
        sums = goals[axis].agg(F.sum("asked"), F.sum("target")).first()
        share = lambda c, all_of: (F.col(c) / F.lit(float(all_of or 0.0) or None)).alias(c)
        reached = raked.groupBy(axis).agg(F.sum("raked").alias("reached"))
        found.append(goals[axis].join(reached, axis).select(
            F.lit(axis).alias("axis"), F.col(axis).alias("level"), share("asked", sums[0]), share("target", sums[1]),
            share("reached", total)))
    return found[0].union(found[1]).union(found[2])


def levelled(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """(row, source, lang, topic, n_tokens): a document's own columns are in ``row``."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"),
                       F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"),
                       (topic_of(text) if topic is None else topic).alias("topic"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def mix_documents(docs: DataFrame, targets: dict | None = None, rate: float = RATE, rounds: int = ROUNDS,
                  id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                  topic: Column | None = None, scratch: Scratch | None = None, repeats: bool = False) -> DataFrame:
    """The documents with ``topic``, ``n_tokens``, ``probability`` and ``kept``; the sample is where ``kept``."""
    rows = weighed_documents(docs, targets, rate, rounds, id_col, text_col, source_col, lang_col, topic, scratch, repeats)
    added = ["topic", "n_tokens", "probability", "kept"]
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def weighed_documents(docs: DataFrame, targets: dict | None = None, rate: float = RATE, rounds: int = ROUNDS,
                      id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                      lang_col: str = "lang", topic: Column | None = None, scratch: Scratch | None = None,
                      repeats: bool = False) -> DataFrame:
    """(row, topic, n_tokens, probability, kept): a document's own columns are in ``row``, so no names clash."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    plain = levelled(docs, text_col, source_col, lang_col, topic)
    cells = scratch.keep(cells_of(plain), "cells")
    goals = targets_of(cells, scratch, {axis: POWER for axis in AXES} | (targets or {}), rate, repeats)
    raked = rake(cells, scratch, goals, rounds, None if repeats else 1 / rate)
    factors = scratch.keep(raked.select(*AXES, (F.col("raked") / F.col("tokens")).alias("factor")), "factors")
    weight = F.coalesce(F.col("factor") * F.lit(float(rate)), F.lit(float(rate)))
    chance = F.round(weight if repeats else F.least(F.lit(1.0), weight), 9)
    number = draw(F.col(f"row.`{id_col}`"))
    rows = plain.join(small_side(factors), AXES, "left").select(
        "row", "topic", "n_tokens", chance.alias("probability"), (number < chance).alias("kept"))
    if not repeats:
        return rows
    copies = F.floor("probability") + (number < F.col("probability") % 1).cast("long")
    each = F.sequence(F.lit(1).cast("long"), F.greatest(copies, F.lit(1)))  # a document without a copy stays, not kept
    return rows.withColumn("kept", copies > 0).withColumn("copy", F.explode(each)).drop("copy")


def sql() -> str:
    """The same as DuckDB SQL over ``documents``, raking unrolled."""
    rules = " ".join(f"WHEN contains(text, '{part}') THEN '{name}'" for name, part in TOPICS)
    steps = [f"""docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN text IS NULL THEN 'none' {rules} ELSE 'prose' END AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
             """cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM docs
    GROUP BY source, lang, topic HAVING sum(n_tokens) > 0)""",
             "w0 AS MATERIALIZED (SELECT *, tokens AS raked FROM cells)"]
    room = f"CAST({max(ROOM, RATE)} AS DOUBLE) / CAST({RATE} AS DOUBLE)"
    for axis in AXES:
        steps.append(f"""level_{axis} AS MATERIALIZED (SELECT {axis}, sum(tokens) AS present, pow(sum(tokens), {POWER}) AS weight
    FROM cells GROUP BY {axis})""")
        steps.append(f"scale_{axis}_0 AS MATERIALIZED (SELECT sum(present) / sum(weight) AS scale, sum(present) AS total FROM level_{axis})")
        for k in range(FILLS):
            steps.append(f"""scale_{axis}_{k + 1} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN weight * scale >= present * {room}
      THEN 0 ELSE weight END) = 0 THEN any_value(scale) ELSE
      (any_value(total) - sum(CASE WHEN weight * scale >= present * {room} THEN present * {room} ELSE 0 END))
      / sum(CASE WHEN weight * scale >= present * {room} THEN 0 ELSE weight END) END AS scale, any_value(total) AS total
    FROM level_{axis}, scale_{axis}_{k})""")
        steps.append(f"""goal_{axis} AS MATERIALIZED (SELECT {axis}, least(weight * scale, present * {room}) AS target
    FROM level_{axis}, scale_{axis}_{FILLS})""")
    number = 0
    bound = f"tokens * (CAST(1 AS DOUBLE) / CAST({RATE} AS DOUBLE))"
    for _ in range(ROUNDS):
        for axis in AXES:
            steps.append(f"""w{number + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(raked * factor, {bound}) AS raked
    FROM w{number} JOIN (SELECT {axis}, CASE WHEN target > now AND now > full_now THEN (target - full_now) / (now - full_now)
            WHEN now > 0 THEN target / now ELSE 0 END AS factor
          FROM (SELECT {axis}, sum(raked) AS now, sum(CASE WHEN raked >= {bound} THEN raked ELSE 0 END) AS full_now
                FROM w{number} GROUP BY {axis}) JOIN goal_{axis} USING ({axis})) USING ({axis}))""")
            number += 1
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, source, lang, topic, n_tokens, probability,
    CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0
        < probability AS kept
FROM (SELECT docs.*, round(least(1.0, coalesce(raked / tokens, 1.0) * CAST({RATE} AS DOUBLE)), 9) AS probability
      FROM docs LEFT JOIN w{number} USING (source, lang, topic))"""
