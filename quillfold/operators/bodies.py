"""JSON bodies of unknown schema as relations: leaves by path, differences, merges, paths to set, business keys.

A body is a JSON text, parsed once into a VARIANT; its containers are opened level
by level inside its row, so no schema is needed, and what meets by ids are bodies,
never their leaves. Nulls are absent. A path joins keys by dots, and items of arrays
by ``[k]``: their position, or the value of their own ``index`` field where that is
asked for. Bodies nested deeper than ``most_depth`` are an error, never cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nested import SERVER_KEYS

# Fields that tell one item of a collection from another, first that is there.
KEY_FIELDS = {"address": ["addressType"], "contact_detail": ["courtContactDescriptionId", "courtContactDescription"], "court_opening_hours": ["openingHourTypeId", "openingHourType"]}


def _is_object(text: Column) -> Column:
    return text.startswith("{") & (F.length(text) > 2)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being made once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def leaf_list(body: Column, skip: tuple[str, ...] = SERVER_KEYS, whole_arrays: bool = False, by_index: bool = False, most_depth: int = 8) -> Column:
    """The leaves of a body as one array of path and value; see `leaves`."""

    def opened(x: Column) -> Column:
        path, v = x["path"], x["v"]
        key = lambda e: F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"]))
        wanted = lambda m: F.filter(m, lambda e: ~e["key"].isin(*skip)) if skip else m
        fields = _let(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda m: F.when(F.size(m) > 0, F.transform(wanted(m), lambda e: F.struct(key(e).alias("path"), e["value"].alias("v")))))
        if whole_arrays:
            return F.coalesce(fields, F.array(x))
        place = lambda y, k: F.coalesce(F.try_variant_get(y, "$.index", "bigint"), k.cast("long")) if by_index else k
        items = _let(F.try_variant_get(v, "$", "array<variant>"), lambda a: F.when(F.size(a) > 0, F.transform(a, lambda y, k: F.struct(F.concat(path, F.lit("["), place(y, k).cast("string"), F.lit("]")).alias("path"), y.alias("v")))))
        return F.coalesce(fields, items, F.array(x))

    rows = F.array(F.struct(F.lit("").alias("path"), F.try_parse_json(body).alias("v")))
    for _ in range(most_depth):
        rows = F.flatten(F.transform(rows, opened))
    told = F.transform(rows, lambda x: F.struct(x["path"].alias("path"), F.to_json(x["v"]).alias("value")))
    deep = lambda text: _is_object(text) if whole_arrays else _is_object(text) | (text.startswith("[") & (F.length(text) > 2))
    checked = lambda x: F.when(deep(x["value"]), F.raise_error(F.lit(f"a body is nested deeper than {most_depth} levels")).cast("boolean")).otherwise(x["value"].isNotNull() & (x["value"] != "null") & (x["path"] != ""))
    return F.filter(told, checked)


def leaves(df: DataFrame, ids: list[str], body: str, skip: tuple[str, ...] = SERVER_KEYS, whole_arrays: bool = False, by_index: bool = False, most_depth: int = 8) -> DataFrame:
    """ids, path and value (JSON text) of every leaf; empty containers are leaves, server-managed keys and nulls are none."""
    return df.select(*ids, F.inline(leaf_list(F.col(body), skip, whole_arrays, by_index, most_depth)))


def differences(before: DataFrame, after: DataFrame, ids: list[str], body: str, **how: object) -> DataFrame:
    """ids, field, before and after of every leaf that differs: both sides' leaves meet by path."""
    one = leaves(before, ids, body, **how).withColumnRenamed("value", "before")
    two = leaves(after, ids, body, **how).withColumnRenamed("value", "after")
    both = one.join(two, [*ids, "path"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(*ids, F.col("path").alias("field"), "before", "after")


def change_maps(changes: DataFrame, ids: list[str]) -> DataFrame:
    """ids with a map from field to (before, after), of every body that differs."""
    pair = F.struct(F.col("field"), F.struct("before", "after"))
    return changes.groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("changes"))


def _above(path: Column) -> Column:
    """All paths that a path lies under."""
    up = _let(F.split(path, r"\."), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), ".")))
    return F.when(path.contains("."), up).otherwise(F.array().cast("array<string>"))


def _paths(rows: Column) -> Column:
    return F.transform(rows, lambda x: x["path"])


def merged(current: DataFrame, submitted: DataFrame, ids: list[str], body: str, fallbacks: tuple[str, ...] = (), clears: DataFrame | None = None) -> DataFrame:
    """ids, path, value and origin (current, submitted) of the merged body's leaves.

    What is submitted wins leaf by leaf, arrays whole; a fallback path yields to what is
    live; a leaf that one side has where the other has an object gives way to what is
    submitted; cleared paths (ids, path) go with all below them. ids name one body of a side.
    """
    both = current.select(*ids, F.col(body).alias("_c")).join(submitted.select(*ids, F.col(body).alias("_s")), ids, "full_outer")
    out = _let(F.struct(leaf_list(F.col("_c"), whole_arrays=True).alias("c"), leaf_list(F.col("_s"), whole_arrays=True).alias("s")), lambda b: _merged(b["c"], b["s"], fallbacks))
    if clears is not None:
        both = both.join(clears.groupBy(*ids).agg(F.collect_set("path").alias("_gone")), ids, "left")
        gone = F.col("_gone")
        out = F.filter(out, lambda x: F.when(gone.isNull(), True).otherwise(~F.exists(gone, lambda p: (x["path"] == p) | x["path"].startswith(F.concat(p, F.lit("."))))))
    return both.select(*ids, F.inline(out)).select(*ids, "path", "value", "origin")


def _merged(cur: Column, sub: Column, fallbacks: tuple[str, ...]) -> Column:
    """The merged leaves of one body's two sides."""
    above = lambda rows: F.flatten(F.transform(rows, lambda x: _above(x["path"])))
    empty = lambda x: x["value"] == "{}"

    def kept(m: Column) -> Column:
        # A leaf of one side above or below leaves of the other.
        mine = F.filter(cur, lambda x: ~F.array_contains(m["over"], x["path"]) & ((F.size(m["under"]) == 0) | ~F.arrays_overlap(_above(x["path"]), m["under"])))
        theirs = F.filter(sub, lambda x: ~(empty(x) & F.array_contains(m["inner"], x["path"])))
        yields = lambda x: x["path"].isin(*fallbacks) if fallbacks else F.lit(False)
        entry = lambda x, loses, origin: F.struct(x["path"].alias("path"), loses.alias("loses"), x["value"].alias("value"), F.lit(origin).alias("origin"))
        return F.array_sort(F.concat(F.transform(theirs, lambda x: entry(x, yields(x), "submitted")), F.transform(mine, lambda x: entry(x, ~yields(x), "current"))))

    def won(rows: Column) -> Column:
        """Of each path the winners, which sort first, or else the losers."""

        def stays(x: Column, i: Column) -> Column:
            before = F.get(rows, i - 1)
            alone = ~before["path"].eqNullSafe(x["path"])
            return F.when(~x["loses"] | alone, True).when(~before["loses"], False).otherwise(~F.exists(rows, lambda y: (y["path"] == x["path"]) & ~y["loses"]))

        return F.filter(rows, stays)

    met = F.struct(
        F.array_intersect(above(cur), _paths(F.filter(sub, lambda x: ~empty(x)))).alias("under"), F.array_intersect(_paths(cur), above(sub)).alias("over"),
        F.array_intersect(above(cur), _paths(F.filter(sub, empty))).alias("inner"),
    )
    return _let(met, lambda m: _let(kept(m), won))


def _text(rows: Column) -> Column:
    """The JSON text that leaves (path, value) make up, null without any: keys in order, array items by their number.

    In order of steps each leaf closes what the one before it left open, and opens what
    lies between; a leaf that is repeated or has others below it goes. Where keys and
    numbers meet, the container is an object.
    """
    step = lambda s: F.struct(F.when(s.startswith("["), F.regexp_extract(s, r"\[(\d+)\]", 1).try_cast("long")).alias("n"), s.alias("key"))
    steps = lambda path: F.transform(F.filter(F.split(F.replace(path, F.lit("["), F.lit(".[")), r"\."), lambda s: s != ""), step)
    placed = F.filter(F.transform(rows, lambda x: F.struct(steps(x["path"]).alias("at"), x["value"].alias("json"))), lambda x: (F.size(x["at"]) > 0) & x["json"].isNotNull())

    def last_of_path(all_: Column) -> Column:
        return F.filter(all_, lambda x, i: ~F.coalesce(F.slice(F.get(all_, i + 1)["at"], 1, F.size(x["at"])) == x["at"], F.lit(False)))

    def with_shared(all_: Column) -> Column:
        """Each leaf with the number of steps that it shares with the one before."""
        same = lambda x, i: F.array_position(F.zip_with(F.get(all_, i - 1)["at"], x["at"], lambda p, q: p.eqNullSafe(q)), False) - 1
        return F.transform(all_, lambda x, i: F.struct(x["at"].alias("at"), x["json"].alias("json"), F.coalesce(same(x, i), F.lit(0)).cast("int").alias("shared")))

    def one_kind(all_: Column) -> Column:
        """Numbers among keys become keys."""
        turns = lambda x, i: F.get(x["at"], x["shared"])["n"].isNotNull() & F.get(F.get(all_, i - 1)["at"], x["shared"])["key"].isNotNull() & F.get(F.get(all_, i - 1)["at"], x["shared"])["n"].isNull()
        mixed = F.transform(F.filter(all_, turns), lambda x: F.slice(x["at"], 1, x["shared"]))
        plain = lambda at, m: F.transform(at, lambda s, k: F.struct(F.when(~F.array_contains(m, F.slice(at, 1, k)), s["n"]).alias("n"), s["key"].alias("key")))
        return _let(mixed, lambda m: F.when(F.size(m) == 0, all_).otherwise(F.transform(all_, lambda x: F.struct(plain(x["at"], m).alias("at"), x["json"].alias("json"), x["shared"].alias("shared")))))

    def written(all_: Column) -> Column:
        item = lambda s: s["n"].isNotNull()
        name = lambda s: F.when(item(s), "").otherwise(F.concat(_let(F.to_json(F.array(s["key"])), lambda t: F.substring(t, F.lit(2), F.length(t) - 2)), F.lit(":")))  # noqa: E731  the key as JSON text
        opening = lambda s, fresh: F.concat(F.when(~fresh, ",").when(item(s), "[").otherwise("{"), name(s))

        def leaf(x: Column, i: Column) -> Column:
            opens = F.transform(F.slice(x["at"], x["shared"] + 1, F.size(x["at"])), lambda s, k: opening(s, (k > 0) | (i == 0)))
            closes = F.transform(F.reverse(F.slice(x["at"], F.coalesce(F.get(all_, i + 1)["shared"], F.lit(-1)) + 2, F.size(x["at"]))), lambda s: F.when(item(s), "]").otherwise("}"))
            return F.concat(F.array_join(opens, ""), x["json"], F.array_join(closes, ""))

        return F.when(F.size(all_) > 0, F.array_join(F.transform(all_, leaf), ""))

    return _let(F.array_sort(placed), lambda a: _let(last_of_path(a), lambda b: _let(with_shared(b), lambda c: _let(one_kind(c), written))))


def rebuilt(rows: DataFrame, ids: list[str]) -> DataFrame:
    """ids and the JSON body that leaves (ids, path, value) make up: keys in order, array items by their number.

    One shuffle by ids; each body is written in its row.
    """
    return rows.groupBy(*ids).agg(F.collect_list(F.struct("path", "value")).alias("_rows")).select(*ids, _text(F.col("_rows")).alias("body"))


def with_path(df: DataFrame, ids: list[str], body: str, edits: DataFrame) -> DataFrame:
    """ids and body after edits (ids, path, value as JSON text): ``a[3].b`` is the field of the item whose index is 3, wherever it stands.

    A path into an item that isn't there changes nothing; what lies below the path goes.
    Edits meet their body by ids, once; ids name one body.
    """
    told = edits.filter("path <> ''").groupBy(*ids).agg(F.collect_list(F.struct("path", "value")).alias("_edits"))
    both = df.select(*ids, F.col(body).alias("_body")).join(told, ids, "full_outer")
    at_or_under = lambda path, top: path.startswith(top) & ((path == top) | F.substring(path, F.length(top) + 1, F.lit(1)).isin(".", "["))

    def there(own: Column) -> Column:
        item = lambda e: F.regexp_extract(e["path"], r"^(.*\])", 1)
        return F.filter(F.coalesce("_edits", F.array().cast("array<struct<path:string,value:string>>")), lambda e: _let(item(e), lambda at: (at == "") | F.exists(own, lambda x: at_or_under(x["path"], at))))

    def edited(own: Column) -> Column:
        return _let(there(own), lambda new: F.concat(F.filter(own, lambda x: ~F.exists(new, lambda e: at_or_under(x["path"], e["path"]))), new))

    text = _text(_let(leaf_list(F.col("_body"), skip=(), by_index=True), edited))
    return both.select(*ids, F.explode(F.array_compact(F.array(text))).alias("body"))


def items_of(df: DataFrame, ids: list[str], body: str, resource: str) -> DataFrame:
    """ids, position, business key and item (JSON text) of a collection body; the resource's first key field that is there counts, of an object its id or name, and an item without one is like no other."""
    spark = df.sparkSession
    rows = df.withColumn("_v", F.try_parse_json(body)).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))

    key = F.concat(F.lit("untyped-"), F.col("pos").cast("string"))
    return rows.select(*ids, F.col("pos").alias("position"), F.coalesce(*[_field_of(f) for f in KEY_FIELDS[resource]], key).alias("key"), F.to_json("value").alias("item"))


def _field_of(name: str) -> Column:
    """A field of the exploded item as text; of an object its id, else its name."""
    text = F.to_json(F.try_variant_get("value", f"$.{name}", "variant"))
    plain = F.when(~text.startswith("{") & (text != "null"), F.try_variant_get("value", f"$.{name}", "string"))
    return F.coalesce(plain, *[F.try_variant_get("value", f"$.{name}.{f}", "string") for f in ("id", "name")])
