"""Diagrams of all applications at once: a row for each line, by application and place.

Each diagram shows things by name until it has ``NODE_CAP`` nodes; the cap is part of what a diagram is. Only the first things of each application and class are
ranked (a limit that is taken before rows are shuffled), as nothing behind them can be shown, so that an application of any size costs one a few thousand rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.labels import diagram_label
from portolan.operators.cooccurrence import HEAVY_MEMBERS, PAIRS_AT_ONCE, RUN
from portolan.sources.store import grown, stored

# ---- what the diagrams say; fixed values

NODE_CAP, ID_CHARS = 80, 60
HEAD = "flowchart LR"
CLASS_STYLE, FOCAL_STYLE = "    classDef classNode fill:#e1eef8,stroke:#1c6fc9,color:#17324d;", "    classDef focalNode fill:#e1eef8,stroke:#1c6fc9,color:#17324d,font-weight:bold;"
CLASS_NOTE = '    nota_truncado["... diagrama truncado (demasiados elementos) — ver la tabla completa abajo"]'
FOCAL_NOTE = '    nota_truncado["... relaciones adicionales truncadas — ver las tablas completas abajo"]'


def node_id(prefix: str, name: Column) -> Column:
    plain = F.left(F.regexp_replace(name, r"(?U)[^\w]", "_"), F.lit(ID_CHARS))
    return F.concat(F.lit(f"{prefix}_"), F.coalesce(F.nullif(plain, F.lit("")), F.lit("n")))


def label(name: Column) -> Column:
    return F.replace(name, F.lit('"'), F.lit("'"))


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def class_resources(findings: DataFrame, io: DataFrame) -> DataFrame:
    """``app_name, class_name, kind, target``: what each class touches. ``findings``: category and target of its statements; ``io``: operation and category."""
    a = findings.filter("target is not null and target <> ''").select("app_name", "class_name", F.when(F.col("category") == "query", "table").otherwise("sp").alias("kind"), "target")
    b = io.select("app_name", "class_name", F.lit("io").alias("kind"), diagram_label(F.col("operation"), F.col("category")).alias("target"))
    return a.unionByName(b).distinct()


def class_diagrams(resources: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    """``app_name, place, line``: classes by name, each with its procedures, tables and other resources. Null names are left out; an application without resources has no lines."""
    rows = resources.select("app_name", "class_name", "kind", "target").filter("app_name is not null and class_name is not null and target is not null").distinct()
    rows = rows.withColumn("group", F.when(F.col("kind") == "io", 3).when(F.col("kind") == "table", 2).otherwise(1))
    of_class = Window.partitionBy("app_name", "class_name").orderBy("group", "target")
    near = rows.withColumn("_k", F.row_number().over(of_class)).filter(F.col("_k") <= 2 * cap)
    classes = rows.select("app_name", "class_name").distinct().withColumn("_c", F.row_number().over(Window.partitionBy("app_name").orderBy("class_name"))).filter(F.col("_c") <= cap)
    near = near.join(classes, ["app_name", "class_name"])
    none = F.lit(None).cast("string")
    items = near.select("app_name", "class_name", "group", "kind", "target").unionByName(classes.select("app_name", "class_name", F.lit(0).alias("group"), none.alias("kind"), none.alias("target")))
    order = Window.partitionBy("app_name").orderBy("class_name", "group", "target")
    new = (F.col("group") == 0) | (F.row_number().over(Window.partitionBy("app_name", "group", "target").orderBy("class_name")) == 1)
    items = items.withColumn("new", new.cast("int")).withColumn("before", F.sum("new").over(order) - F.col("new")).filter(F.col("before") < cap)

    one = node_id("class", F.col("class_name"))
    at = F.when(F.col("kind") == "sp", node_id("sp", F.col("target"))).when(F.col("kind") == "table", node_id("table", F.col("target"))).otherwise(node_id("io", F.col("target")))
    text = label(F.col("target"))
    node = (
        F.when(F.col("group") == 0, _said("    ", one, '["', label(F.col("class_name")), '"]:::classNode'))
        .when(F.col("kind") == "table", _said("    ", at, '[("', text, '")]')).when(F.col("kind") == "sp", _said("    ", at, '[["', text, '"]]')).otherwise(_said("    ", at, '("', text, '")'))
    )
    edge = F.when(F.col("group") > 0, _said("    ", one, F.when(F.col("kind") == "io", " -.-> ").otherwise(" --> "), at))
    lines = F.filter(F.array(F.when(F.col("new") == 1, node), edge), lambda x: x.isNotNull())
    shown = items.select("app_name", F.lit(1).alias("part"), "class_name", "group", "target", F.posexplode(lines).alias("sub", "line"))
    n_all = rows.groupBy("app_name").agg((F.count(F.lit(1)) + F.count_distinct("class_name")).alias("all"))
    counts = n_all.join(items.groupBy("app_name").agg(F.count(F.lit(1)).alias("shown")), "app_name")
    return _placed(shown, counts, CLASS_NOTE, CLASS_STYLE, ["class_name", "group", "target", "sub"])


def _placed(shown: DataFrame, counts: DataFrame, note: str, style: str, order: list[str]) -> DataFrame:
    """The lines of ``shown`` between the head and the style, with the note where ``counts`` has more than is shown."""
    frame = F.array(F.struct(F.lit(0).alias("part"), F.lit(HEAD).alias("line")), F.struct(F.lit(3).alias("part"), F.lit(style).alias("line")), F.when(F.col("all") > F.col("shown"), F.struct(F.lit(2).alias("part"), F.lit(note).alias("line"))))
    around = counts.select("app_name", F.inline(F.filter(frame, lambda x: x.isNotNull())))
    whole = shown.unionByName(around, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("app_name").orderBy("part", *order))
    return whole.select("app_name", place.cast("bigint").alias("place"), "line")


def relation_diagrams(relations: DataFrame, loops: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    """``app_name, place, line``: each application in the middle, with arrows to those that read what it writes and from those that write what it
    reads, named by their tables, and to itself. ``relations``: producer, consumer, written, read (the table as either spells it), a row for each table; ``loops``: app_name, table."""
    out = relations.select(F.col("producer").alias("app_name"), F.lit(1).alias("part"), F.col("consumer").alias("other"), F.col("written").alias("table"))
    into = relations.select(F.col("consumer").alias("app_name"), F.lit(2).alias("part"), F.col("producer").alias("other"), F.col("read").alias("table"))
    arrows = out.unionByName(into).filter("app_name <> other").groupBy("app_name", "part", "other").agg(F.array_join(F.array_sort(F.collect_set("table")), ", ").alias("tables"))
    own = loops.select("app_name", "table").distinct()
    n_arrows = arrows.groupBy("app_name").agg(F.count(F.lit(1)).alias("all"))
    near = arrows.withColumn("_k", F.row_number().over(Window.partitionBy("app_name", "part").orderBy("other"))).filter(F.col("_k") <= cap)
    new = (F.row_number().over(Window.partitionBy("app_name", "other").orderBy("part")) == 1).cast("int")
    items = near.withColumn("new", new)
    items = items.withColumn("before", 1 + F.sum("new").over(Window.partitionBy("app_name").orderBy("part", "other")) - F.col("new")).filter(F.col("before") < cap)
    me, you = node_id("app", F.col("app_name")), node_id("app", F.col("other"))
    tables = _said(' -->|"', label(F.col("tables")), '"| ')
    node = F.when(F.col("new") == 1, _said("    ", you, '("', label(F.col("other")), '")'))
    edge = F.when(F.col("part") == 1, _said("    ", me, tables, you)).otherwise(_said("    ", you, tables, me))
    shown = items.select("app_name", F.lit(1).alias("part"), F.col("part").alias("side"), "other", F.posexplode(F.filter(F.array(node, edge), lambda x: x.isNotNull())).alias("sub", "line"))
    turns = own.select("app_name", F.lit(1).alias("part"), F.lit(3).alias("side"), F.col("table").alias("other"), F.lit(0).alias("sub"), _said("    ", me, ' -->|"', label(F.col("table")), '"| ', me).alias("line"))
    apps = n_arrows.select("app_name").unionByName(own.select("app_name")).distinct()
    centre = apps.select("app_name", F.lit(1).alias("part"), F.lit(0).alias("side"), F.lit("").alias("other"), F.lit(0).alias("sub"), _said("    ", me, '["', label(F.col("app_name")), '"]:::focalNode').alias("line"))
    counts = apps.join(n_arrows, "app_name", "left").join(items.groupBy("app_name").agg(F.count(F.lit(1)).alias("shown")), "app_name", "left").na.fill(0, ["all", "shown"])
    return _placed(shown.unionByName(turns).unionByName(centre), counts, FOCAL_NOTE, FOCAL_STYLE, ["side", "other", "sub"])


def relation_texts(sides: DataFrame, sizes: DataFrame, name: Callable[[Column], Column] = lambda c: c, cap: int = NODE_CAP, hot_members: int = HEAVY_MEMBERS) -> DataFrame:
    """``app_name, n_lines, mermaid``: the ``relation_diagrams`` of all applications as texts, from who does what to each table: ``sides`` (key, member, side: 1 writes, 2 reads, 3 both; table as the
    member spells it), a row for each key and member. ``sizes`` (key, n): at least how many rows each key has; ``name``: a member's name, each its own.

    No pairs are made: what an application can show of a table's others are the first ``cap`` by name, which are the same for all of the table's members, so each
    gets that list (two more: itself, and one that tells that there are more). Lists of ids move once, to the application; names are made there. Tables of more than ``hot_members`` rows give their
    lists in slots of about ``RUN`` members.
    """
    rows = sides.filter("key is not null and member is not null").select("key", "member", "side", "table")
    most = F.least("n", F.lit(2 * cap + 4))
    top, pairs = sizes.agg(F.max("n"), F.sum(most * F.col("n"))).first()
    makes, reads, listed = F.col("side").bitwiseAND(1) != 0, F.col("side").bitwiseAND(2) != 0, cap + 2
    by_name, whole = Window.partitionBy("key").orderBy(name(F.col("member"))), Window.partitionBy("key")
    hot = stored(sizes.filter(F.col("n") > hot_members)) if (top or 0) > hot_members else None
    cold = rows if hot is None else rows.join(hot, "key", "left_anti")
    so_far = cold.withColumns({"p": F.count_if(makes).over(by_name.rowsBetween(Window.unboundedPreceding, 0)), "c": F.count_if(reads).over(by_name.rowsBetween(Window.unboundedPreceding, 0))})
    near = lambda side, k: F.collect_list(F.when(side & (F.col(k) <= listed), F.col("member"))).over(whole)
    given = so_far.withColumns({"makers": near(makes, "p"), "readers": near(reads, "c")}).drop("p", "c", "key")
    if hot is not None:
        warm = rows.join(hot, "key")

        def firsts(side: Column, to: str) -> DataFrame:
            return warm.filter(side).withColumn("k", F.row_number().over(by_name)).filter(F.col("k") <= listed).groupBy("key").agg(F.collect_list("member").alias(to))

        slots = F.ceil(F.col("n") / RUN)
        lists = hot.join(firsts(makes, "makers"), "key", "left").join(firsts(reads, "readers"), "key", "left").select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), slots - 1)).alias("slot"), "makers", "readers")
        dealt = warm.withColumn("slot", F.pmod(F.xxhash64("member"), slots)).select("key", "slot", "member", "side", "table")
        given = given.unionByName(dealt.join(grown(lists), ["key", "slot"]).select(*given.columns))
    others = lambda side, c: F.coalesce(F.when(side, F.array_remove(c, F.col("member"))), F.array().cast(given.schema[c].dataType))
    given = given.select(name(F.col("member")).alias("app_name"), "side", "table", others(makes, "readers").alias("out"), others(reads, "makers").alias("into"))
    given = given.filter("side = 3 or size(out) > 0 or size(into) > 0")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(pairs or 0) // PAIRS_AT_ONCE))

    # from here on everything is by application and moves no more; lambdas and what they are given are interpreted, so there are none
    turn = F.when(F.col("side") == 3, F.array(F.lit(None).cast(rows.schema["member"].dataType))).otherwise(F.array())
    met = given.repartition(tasks, "app_name").select("app_name", "table", F.size("out").alias("n_out"), F.posexplode(F.concat("out", "into", turn)).alias("pos", "id"))
    loop = F.col("id").isNull()
    met = met.select("app_name", "table", loop.alias("loop"), F.when(loop, F.col("table")).otherwise(name(F.col("id"))).alias("other"), (~loop & (F.col("pos") < F.col("n_out"))).alias("out"))
    named = lambda part: F.sort_array(F.collect_set(F.when(part, F.col("table"))))
    items = met.groupBy("app_name", "loop", "other").agg(named(F.col("out")).alias("t1"), named(~F.col("loop") & ~F.col("out")).alias("t2"))
    items = items.withColumns({"in1": F.size("t1") > 0, "in2": F.size("t2") > 0})
    order = Window.partitionBy("app_name").orderBy("loop", "other").rowsBetween(Window.unboundedPreceding, 0)
    in1, in2, new2 = F.col("in1"), F.col("in2"), F.col("in2") & ~F.col("in1")
    items = items.withColumns({"k1": F.count_if(in1).over(order), "k2": F.count_if(in2).over(order), "m2": F.count_if(new2).over(order), "all1": F.count_if(in1).over(Window.partitionBy("app_name"))})
    items = items.withColumns({"new2": new2, "show1": in1 & (F.col("k1") < cap), "show2": in2 & (F.col("k2") <= cap) & (1 + F.least("all1", F.lit(cap)) + F.col("m2") - new2.cast("int") < cap)})
    show1, show2, new2 = F.col("show1"), F.col("show2"), F.col("new2")
    more = (in1 & ~show1) | (in2 & ~show2)
    items = items.filter(show1 | show2 | F.col("loop") | more).withColumns({"me": node_id("app", F.col("app_name")), "you": F.when(~F.col("loop"), node_id("app", F.col("other")))})
    me, you, text = F.col("me"), F.col("you"), label(F.col("other"))
    node = _said("    ", you, '("', text, '")\n')
    arrow = lambda a, tables, b: _said("    ", a, ' -->|"', tables, '"| ', b)
    shown = lambda side: label(F.array_join(side, ", "))
    drawn = {
        "a": F.when(show1, F.concat(node, arrow(me, shown("t1"), you))), "b": F.when(show2, F.concat(F.when(new2, node).otherwise(""), arrow(you, shown("t2"), me))), "l": F.when(F.col("loop"), arrow(me, text, me)),
    }
    n_lines = 2 * show1.cast("int") + show2.cast("int") + (show2 & new2).cast("int") + F.col("loop").cast("int")
    drawn_items = items.select("app_name", "other", more.alias("more"), n_lines.alias("n"), *[line.alias(k) for k, line in drawn.items()])
    lists = [F.sort_array(F.collect_list(F.when(F.col(k).isNotNull(), F.struct("other", F.col(k).alias("line"))))).alias(k) for k in drawn]  # as few as the nodes and the tables that are both written and read
    held = drawn_items.groupBy("app_name").agg(F.max("more").alias("more"), F.sum("n").alias("n"), *lists)
    me = node_id("app", F.col("app_name"))
    head = F.array(F.lit(HEAD), _said("    ", me, '["', label(F.col("app_name")), '"]:::focalNode'))
    end = F.when(F.col("more"), F.array(F.lit(FOCAL_NOTE), F.lit(FOCAL_STYLE))).otherwise(F.array(F.lit(FOCAL_STYLE)))
    return held.select("app_name", (F.col("n") + 3 + F.col("more").cast("int")).alias("n_lines"), F.array_join(F.concat(head, F.col("a.line"), F.col("b.line"), F.col("l.line"), end), "\n").alias("mermaid"))


def texts(lines: DataFrame) -> DataFrame:
    """``app_name, n_lines, mermaid`` of diagrams; their lines are as few as their nodes."""
    held = lines.groupBy("app_name").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    return held.select("app_name", F.size("x").cast("bigint").alias("n_lines"), F.array_join(F.transform("x", lambda r: r.line), "\n").alias("mermaid"))
