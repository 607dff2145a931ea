"""Knowledge-base extraction (B1-B17): from parsed dump entities to the
name table."""

from __future__ import annotations

import functools
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, measured_side

DEFAULT_LANGUAGE = "en"


def instance_of(reference_mode: bool = True) -> Column:
    """B2: distinct P31 target ids. Reference mode: one snak without a value
    makes the whole set empty (all-or-nothing)."""
    snaks = F.coalesce(F.col("claims.P31"), F.array())
    ids = F.array_distinct(F.transform(snaks, lambda s: s["mainsnak"]["datavalue"]["value"]["id"]))
    if reference_mode:
        return F.when(F.exists(ids, lambda x: x.isNull()), F.array().cast("array<string>")).otherwise(ids)
    return F.filter(ids, lambda x: x.isNotNull())


def labels_map() -> Column:
    """Language -> label text."""
    return F.transform_values(F.coalesce(F.col("labels"), F.create_map().cast("map<string,struct<language:string,value:string>>")),
                              lambda k, v: v["value"])


def label_languages() -> Column:
    """B4."""
    return F.map_keys(F.coalesce(F.col("labels"), F.create_map().cast("map<string,struct<language:string,value:string>>")))


def entity_name(default_language: str = DEFAULT_LANGUAGE) -> Column:
    """Label in the default language, else the id."""
    return F.coalesce(F.col("labels")[default_language]["value"], F.col("id"))


def simplify_entities(dump: DataFrame, reference_mode: bool = True,
                      default_language: str = DEFAULT_LANGUAGE) -> DataFrame:
    """B1: raw entity -> (id, name, aliases, instance_of, languages)."""
    return dump.select("id", entity_name(default_language).alias("name"), labels_map().alias("aliases"),
                       instance_of(reference_mode).alias("instance_of"), label_languages().alias("languages"))


def is_instance_of(entities: DataFrame, classes: Sequence[str] | DataFrame) -> DataFrame:
    """Entities whose instance_of meets the class set. A literal list
    uses ``arrays_overlap``; a DataFrame of classes (any size) a join on
    the exploded classes, for which the entities are computed once. Rows of one id go together."""
    if isinstance(classes, DataFrame):
        wanted = measured_side(classes.select(F.col("class").alias("_class")).distinct().withColumn("_hit", F.lit(True)))
        rows = entities.withColumn("_row", F.monotonically_increasing_id()).withColumn("_class", F.explode_outer("instance_of"))
        # rows without a class have a key of their own each, so that they are not all in one task
        rows = rows.withColumn("_class", F.coalesce("_class", F.concat(F.lit("\0"), F.col("_row").cast("string"))))
        each = (rows.join(wanted, "_class", "left").groupBy("_row")
                .agg(*[F.first(c).alias(c) for c in entities.columns], F.max("_hit").alias("_hit")))
        hit = F.max("_hit").over(Window.partitionBy("id"))
        return each.withColumn("_hit", hit).where("_hit and id is not null").select(*entities.columns)
    return entities.filter(F.arrays_overlap("instance_of", F.array(*[F.lit(c) for c in classes])))


def has_claim(dump: DataFrame, prop: str = "P31", n: int | None = None) -> DataFrame:
    """Documents having the property (at most n, by id)."""
    out = dump.filter(F.size(F.coalesce(F.col(f"claims.{prop}"), F.array())) > 0)
    return out.orderBy("id").limit(n) if n else out


#: Types whose reachability one 64-bit set holds; more are worked off in groups.
TYPES_PER_SET = 60
#: Rows (class and a class above it) per partition.
CLOSURE_ROWS_PER_PARTITION = 1_000_000


def class_types(edges: DataFrame, roots: DataFrame, types: Sequence[str]) -> DataFrame:
    """(class, bits): bit k is set for the classes below (or at) a root of ``types[k]``.

    Pointer doubling: round k knows each class's types within 2^k steps and the classes exactly 2^k steps above it;
    following these once more doubles both. It ends when a round changes no class's types (a type found later
    would have been found by some class in every round before), so after about log2 of the depth rounds, cycles
    included.
    """
    number = F.create_map(*[F.lit(x) for k, t in enumerate(types) for x in (t, 1 << k)])
    at_root = (roots.where(F.col("type").isin(list(types)))
               .select(F.col("root").alias("class"), F.element_at(number, F.col("type")).cast("long").alias("bits")))
    jump = materialize(edges.where("child is not null and parent is not null and child != parent")
                       .select(F.col("child").alias("class"), F.col("parent").alias("above")).distinct())
    rows = jump.count()
    parts = lambda n: max(1, -(-n // CLOSURE_ROWS_PER_PARTITION))
    every = jump.select("class").union(jump.select("above")).union(at_root.select("class")).distinct()
    bits = (every.join(at_root.groupBy("class").agg(F.bit_or("bits").alias("bits")), "class", "left")
            .select("class", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))
    bits = materialize(bits.coalesce(parts(rows)))
    while True:
        got = (jump.join(bits.select(F.col("class").alias("above"), F.col("bits").alias("more")).where("more != 0"), "above")
               .groupBy("class").agg(F.bit_or("more").alias("more")))
        new = bits.join(got, "class", "left").select("class", F.col("bits").bitwiseOR(F.coalesce("more", F.lit(0).cast("long"))).alias("now"), "bits")
        new = materialize(new.coalesce(parts(rows)))
        moved = new.where("now != bits").limit(1).count()
        bits = new.select("class", F.col("now").alias("bits"))
        if not moved:
            return bits.where("bits != 0")
        further = jump.join(jump.select(F.col("class").alias("above"), F.col("above").alias("next")), "above")
        jump = materialize(further.select("class", F.col("next").alias("above")).distinct().coalesce(parts(rows)))
        rows = jump.count()


def subclass_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(type, class) of every transitive subclass of each root (root included)."""
    types = sorted(r.type for r in roots.select("type").distinct().collect())
    out = []
    for a in range(0, max(1, len(types)), TYPES_PER_SET):
        some = types[a:a + TYPES_PER_SET]
        named = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, F.lit(t)) for k, t in enumerate(some)]),
                         lambda t: t.isNotNull()) if some else F.array().cast("array<string>")
        found = class_types(edges, roots, some) if some else roots.select(F.col("root").alias("class"), F.lit(0).cast("long").alias("bits"))
        out.append(found.select(F.explode(named).alias("type"), "class"))
    return functools.reduce(DataFrame.union, out)


def filter_by_class(entities: DataFrame, closure: DataFrame, type_: str) -> DataFrame:
    """Entities with a class in the closure of ``type_``."""
    cls = closure.filter(F.col("type") == type_).select("class")
    return is_instance_of(entities, cls)


def filter_by_any_language(entities: DataFrame, languages: Iterable[str] = (DEFAULT_LANGUAGE,)) -> DataFrame:
    """Entities with a label in any of the languages (default ``en``)."""
    return entities.filter(F.arrays_overlap("languages", F.array(*[F.lit(x) for x in languages])))


def filter_by_ids(entities: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Id in a list or in a DataFrame of ids (semi join)."""
    if isinstance(ids, DataFrame):
        return entities.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), on="id", how="left_semi")
    return entities.filter(F.col("id").isin(list(ids)))


def limit_entities(entities: DataFrame, n: int) -> DataFrame:
    """The first n entities (deterministic: by id)."""
    return entities.orderBy("id").limit(n)


def explode_names(entities: DataFrame, type_: str | Column | None = None) -> DataFrame:
    """One row per (entity, label language)."""
    t = F.lit(type_) if isinstance(type_, str) else (type_ if type_ is not None else F.col("type"))
    return entities.select(F.col("id").alias("wikidata_id"), "name",
                           F.explode("aliases").alias("language", "alias"), t.alias("type"))


def filter_output_languages(names: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (),
                            strict: bool = False, lang: str = "language") -> DataFrame:
    """Strict -> in include and not in exclude; else only not in exclude."""
    cond = ~F.col(lang).isin(list(exclude)) if exclude else F.lit(True)
    if strict:
        cond = cond & F.col(lang).isin(list(include))
    return names.filter(cond)


def dump_names(entities: DataFrame, closure: DataFrame, languages: Sequence[str] | None = (DEFAULT_LANGUAGE,),
               include: Sequence[str] = (), exclude: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Names of all typed entities; an entity of two types appears
    once per type. One join with (class, type) replaces one scan per type."""
    ents = filter_by_any_language(entities, languages) if languages else entities
    # an entity is one row from here on: its classes are set out, get their types and come together again, each
    # task's own before anything moves, so that the entities are read and moved once
    of_class = measured_side(closure.groupBy("class").agg(F.collect_set("type").alias("_types")))
    rows = ents.select(F.struct("*").alias("_e"), F.monotonically_increasing_id().alias("_row"))
    typed = (rows.select("_e", "_row", F.explode("_e.instance_of").alias("class")).join(of_class, "class").groupBy("_row")
             .agg(F.first("_e").alias("_e"), F.array_distinct(F.flatten(F.collect_set("_types"))).alias("_types")))
    names = explode_names(typed.select("_e.*", F.explode("_types").alias("type")))
    return filter_output_languages(names, include, exclude, strict)


def collect_instance_of(exploded: DataFrame, id_col: str = "id", value: str = "instance_of") -> DataFrame:
    """Regroup unwound P31 rows: list of classes + the other fields of
    one document (the smallest, for determinism). Lists are per entity and
    bounded by its number of classes."""
    others = [c for c in exploded.columns if c not in (id_col, value)]
    agg = [F.sort_array(F.collect_list(value)).alias(value)]
    if others:
        agg.append(F.min(F.struct(*others)).alias("_doc"))
    g = exploded.groupBy(id_col).agg(*agg)
    return g.select(id_col, value, *[F.col(f"_doc.{c}").alias(c) for c in others]) if others else g


def upsert_entities(base: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Full outer join; a field set in the update wins (``$set`` with
    upsert)."""
    cols = [c for c in base.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols if c in updates.columns])
    j = base.join(u, on=key, how="full")
    return j.select(key, *[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in updates.columns else F.col(c)
                           for c in cols])
