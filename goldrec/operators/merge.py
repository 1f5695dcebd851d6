"""Merging any number of source records into one golden record per entity.

Sources are rows (entity_key, source, input_ord, canonical fields). A record is taken apart into its scalars and the items
of its lists, which are aggregated by (entity_key, source) and by (entity_key, list, item key); a second aggregation by
entity_key puts the golden record together. An entity with very many rows is never gathered whole: what reaches its second
step is a row per source and per different item. Values are chosen by source priority,
then input order, then a hash of the record, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldrec.functions.rows import dealt
from goldrec.functions.text import identity_key, strip
from goldrec.operators.constraints import MOST_ITEMS
from goldrec.plans.config import FIELDS, LISTS, STRUCTURED, Policy, Rule
from goldrec.schema import CONTACT_FIELDS, PROVENANCE, SCALARS

#: Different items of an entity's list that may be gathered in one task; far above what a record may have.
GATHER = 10_000

#: Where each scalar field of the policy lies in a record.
PATHS = {n: n for n in SCALARS} | {f"contact.{c}": f"contact.{c}" for c in CONTACT_FIELDS}


def rank(priority: tuple[str, ...], source: str = "source") -> str:
    """SQL of a source's place in the priority, unknown ones last."""
    known = ", ".join(f"'{s}'" for s in priority)
    return f"coalesce(nullif(int(array_position(array({known}), {source})), 0) - 1, {len(priority)})"


def _present(value: str, kind: str = "string") -> str:
    """An empty text is no value; a blank one is. Lists inside a record always are."""
    return f"{value} IS NOT NULL" + (f" AND {value} <> ''" if kind == "string" else "")


def _turned(sources: DataFrame) -> DataFrame:
    """sources with `_turn`, a record's place among its source's: input order, then a hash of all that it holds."""
    hashed = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in sources.schema.fields]
    return sources.withColumn("_turn", F.struct(F.col("input_ord").cast("long").alias("ord"), F.xxhash64(*hashed).alias("tie")))


def _said(value: str, score: str | None, turn: str) -> str:
    """What a source's records say of one scalar field: its first value, its extremes, and its best scored value."""
    has = _present(value)
    best = f"min(CASE WHEN {has} AND {score} IS NOT NULL THEN named_struct('s', -{score}, 'o', {turn}, 'v', {value}) END)"
    none = "CAST(NULL AS struct<s:double,o:struct<ord:bigint,tie:bigint>,v:string>)"
    first = f"min(CASE WHEN {has} THEN named_struct('o', {turn}, 'v', {value}) END)"
    return f"named_struct('first', {first}, 'low', min(CASE WHEN {has} THEN {value} END), 'high', max(CASE WHEN {has} THEN {value} END), 'best', {best if score else none})"


def _ordered(name: str, rule: Rule, scored: bool) -> str:
    """What `_resolve` needs of a scalar field, from the array `_sources` of what each source says."""
    place = rank(rule.priority, "x.source")
    firsts = f"sort_array(transform(filter(_sources, x -> x.{name}.first IS NOT NULL), x -> named_struct('r', {place}, 'o', x.{name}.first.o, 's', x.source, 'v', x.{name}.first.v)))"
    bests = f"sort_array(transform(filter(_sources, x -> x.{name}.best IS NOT NULL), x -> named_struct('c', x.{name}.best.s, 'r', {place}, 'o', x.{name}.best.o, 's', x.source, 'v', x.{name}.best.v)))"
    differ = f"coalesce(array_min(transform(_sources, x -> x.{name}.low)) <> array_max(transform(_sources, x -> x.{name}.high)), false)"
    best = f"get({bests}, 0)" if scored and rule.strategy == "highest_confidence" else "CAST(NULL AS struct<c:double,r:int,o:struct<ord:bigint,tie:bigint>,s:string,v:string>)"
    return f"named_struct('firsts', {firsts}, 'best', {best}, 'differ', {differ}) AS {name}"


def _resolve(name: str, rule: Rule) -> str:
    """value, winner (its source), conflict and contributing (sources in priority order) of a scalar field."""
    first, sources = f"get({name}.firsts, 0)", f"array_distinct({name}.firsts.s)"
    if rule.strategy == "first_non_empty":
        return f"named_struct('value', {first}.v, 'winner', {first}.s, 'conflict', false, 'contributing', slice({sources}, 1, 1)) AS {name}"
    return f"named_struct('value', coalesce({name}.best.v, {first}.v), 'winner', coalesce({name}.best.s, {first}.s), 'conflict', {name}.differ, 'contributing', {sources}) AS {name}"


#: All of an entity's sources, in the usual order.
CONSIDERED = f"sort_array(transform(_sources, x -> named_struct('r', {rank(('ATS', 'RESUME'), 'x.source')}, 's', x.source))).s AS considered"


def _resolved(said: DataFrame, rules: dict[str, Rule], scored: set[str], *more: str) -> DataFrame:
    """entity_key, considered, a struct per field and more columns, of rows (entity_key, _sources, ...)."""
    rest = [c for c in said.columns if c not in ("entity_key", "_sources")]
    ordered = said.selectExpr("entity_key", CONSIDERED, *(_ordered(n, r, n in scored) for n, r in rules.items()), *rest, *more)
    kept = [c for c in ordered.columns if c not in rules]
    return ordered.selectExpr(*kept, *(_resolve(n, r) for n, r in rules.items()))


def merge_scalars(sources: DataFrame, fields: dict[str, tuple[Column, Rule]], scores: dict[str, Column] | None = None) -> DataFrame:
    """entity_key, considered (all its sources) and a struct (value, winner, conflict, contributing) per field."""
    scores = scores or {}
    turned = _turned(sources).select("entity_key", "source", "_turn", *(v.alias(f"_v_{n}") for n, (v, _) in fields.items()), *(s.alias(f"_s_{n}") for n, s in scores.items()))
    said = turned.groupBy("entity_key", "source").agg(*(F.expr(_said(f"_v_{n}", f"_s_{n}" if n in scores else None, "_turn")).alias(n) for n in fields))
    each = said.groupBy("entity_key").agg(F.collect_list(F.struct("source", *fields)).alias("_sources"))  # a row a source
    return _resolved(each, {n: r for n, (_, r) in fields.items()}, set(scores)).select("entity_key", "considered", *fields)


def _slots(sources: DataFrame) -> dict[str, str]:
    """What an item may be, and its type: a text, a provenance entry, or a record of a list that the sources have."""
    return {"text": "string", "prov": PROVENANCE} | {n: sources.schema[n].dataType.elementType.simpleString() for n in STRUCTURED if n in sources.columns}


def _items(sources: DataFrame, name: str, rule: Rule) -> Column:
    """The items of one list as (kind, key, place, text, ...), the slot that holds the item filled."""
    mine = name if name in STRUCTURED else "prov" if name == "provenance" else "text"

    def item(x: Column, i: Column) -> Column:
        if name in STRUCTURED:
            key = identity_key(*(x[k] for k in rule.identity))
        else:
            key = F.concat_ws("\x1f", x.field, x.source) if name == "provenance" else F.lower(strip(x))
        place = F.struct(F.expr(rank(rule.priority)).alias("r"), F.col("_turn").alias("o"), i.cast("int").alias("p"))
        return F.struct(F.lit(name).alias("kind"), key.alias("key"), place.alias("place"), *((x if s == mine else F.lit(None).cast(t)).alias(s) for s, t in _slots(sources).items()))

    return F.transform(F.coalesce(F.col(name), F.array().cast(sources.schema[name].dataType)), item)


def _firsts(sources: DataFrame) -> list[Column]:
    """Aggregates of the items of one key: the first place, and the item: the first spelling of a text; of records the
    first, its missing fields (null or empty text) filled from later ones, lists inside it never filled; the last
    provenance."""
    out = ["min(place) AS at", "min_by(text, CASE WHEN text IS NOT NULL THEN place END) AS text", "max_by(prov, CASE WHEN prov IS NOT NULL THEN place END) AS prov"]
    for name in (n for n in STRUCTURED if n in sources.columns):
        fields = []
        for f in sources.schema[name].dataType.elementType.fields:
            value, kind = f"{name}.`{f.name}`", f.dataType.typeName()
            has = f"{name} IS NOT NULL" if kind == "array" else _present(value, kind)
            fields.append(f"'{f.name}', min_by({value}, CASE WHEN {has} THEN place END)")
        out.append(f"named_struct({', '.join(fields)}) AS {name}")
    return [F.expr(x) for x in out]


def _list(name: str) -> Column:
    """The items of a list of an entity, in order; a golden list has hundreds of items at most."""
    slot = name if name in STRUCTURED else "text"
    return F.expr(f"sort_array(collect_list(CASE WHEN kind = '{name}' THEN named_struct('at', at, 'item', {slot}) END)).item AS {name}")


def _union(sources: DataFrame, name: str, rule: Rule) -> DataFrame:
    each = _turned(sources).select("entity_key", F.explode(_items(sources, name, rule)).alias("i")).select("entity_key", "i.*").where("key <> ''")
    return each.groupBy("entity_key", "kind", "key").agg(*_firsts(sources)).groupBy("entity_key").agg(_list(name))


def union_flat(sources: DataFrame, name: str, rule: Rule) -> DataFrame:
    """entity_key and the union of a list of texts: the first spelling of each, in priority order, then list order."""
    return _union(sources, name, rule)


def union_records(sources: DataFrame, name: str, rule: Rule) -> DataFrame:
    """entity_key and the union of a list of records by their identity, gaps filled."""
    return _union(sources, name, rule)


def merge(sources: DataFrame, policy: Policy | None = None, gather: int = GATHER, raw: DataFrame | None = None) -> DataFrame:
    """Golden records: canonical fields, provenance, `considered` and `merge_report`, a row per field of the policy.

    Scores for `highest_confidence` come from a `confidence` column (fields: name -> score), where there is one; without
    one that strategy is `source_priority`. Entities without a first and last name, and those of which a merged list is
    longer than a record's may be, are returned with an error_type. Lists of more than `gather` different items are
    counted, never gathered. raw: the same records before a step that makes no list longer; entities of many records and
    items are told from these, so that the step isn't done for counting.
    """
    policy = policy or Policy()
    if "provenance" not in sources.columns:
        sources = sources.withColumn("provenance", F.array().cast(f"array<{PROVENANCE}>"))
    key = {n: n.replace(".", "_") for n in PATHS}
    rules = {key[n]: policy.rule(n) for n in PATHS}
    scored = set(rules) if "confidence" in sources.columns else set()
    lists, bare = LISTS + STRUCTURED, lambda n: n.removeprefix("contact.")

    # Taken apart: one row with the scalars (no kind, no key), one per item of a list.
    nothing = ", ".join(f"'{s}', CAST(NULL AS {t})" for s, t in _slots(sources).items())
    parts = [f"'{key[n]}', {p}" for n, p in PATHS.items()] + [f"'{key[n]}_score', try_element_at(confidence.fields, '{bare(n)}').score" for n in PATHS if scored]
    scalars = F.expr(f"named_struct({', '.join(parts)}, {', '.join(f"'had_{n}', size({n}) > 0" for n in lists)}, 'prov', provenance)")
    whole = F.expr(f"named_struct('kind', '', 'key', '', 'place', named_struct('r', 0, 'o', _turn, 'p', 0), {nothing})").withField("source", F.col("source")).withField("record", scalars)
    record = sources.select(scalars.alias("r")).schema["r"].dataType
    # An item's row holds nothing of the record.
    bare_item = lambda x: x.withField("source", F.lit(None).cast("string")).withField("record", F.lit(None).cast(record))
    items = [F.transform(c, bare_item) for c in (*(_items(sources, n, policy.rule(n)) for n in lists), _items(sources, "provenance", Rule()))]
    taken_apart = lambda rows, *what: _turned(rows).select("entity_key", F.explode(F.concat(*what)).alias("i")).select("entity_key", "i.*").where("kind = '' OR key <> ''")
    apart = taken_apart(sources, F.array(whole), *items).withColumnRenamed("record", "_record")

    # First step: by source, or by item. Second step: the entity.
    said = [f"'{key[n]}', {_said(f'_record.{key[n]}', f'_record.{key[n]}_score' if scored else None, 'place.o')}" for n in PATHS]
    said += [f"'had_{n}', max(_record.had_{n})" for n in lists] + ["'prov', min_by(_record.prov, CASE WHEN _record IS NOT NULL THEN place.o END)"]
    told = ", ".join(f"'{x}', _said.{x}" for x in (*rules, *(f"had_{n}" for n in lists), "prov"))

    def gathered(rows: DataFrame, within: Callable[[DataFrame], DataFrame]) -> DataFrame:
        apart = taken_apart(rows, F.array(whole), *items).withColumnRenamed("record", "_record")
        first = within(apart.groupBy("entity_key", "kind", "key", "source").agg(F.expr(f"named_struct({', '.join(said)})").alias("_said"), *_firsts(sources)))
        return first.groupBy("entity_key").agg(
            F.expr(f"collect_list(CASE WHEN kind = '' THEN named_struct('source', source, {told}) END) AS _sources"),
            F.expr("collect_list(CASE WHEN kind = 'provenance' THEN prov END) AS _last"), F.expr("collect_list(CASE WHEN _n IS NOT NULL THEN kind END) AS _over"), *map(_list, lists),
        )

    # Entities of few records and items, nearly all, are dealt whole over as many tasks as their records need: both steps
    # are done where they are. Those of more than `gather` are aggregated where their records are read, before any shuffle,
    # and a list of more different items than may be gathered is left at one item that tells of it. The tables of such
    # entities and lists have a row per more than `gather` items at most.
    held = [F.count(F.lit(1)).alias("_rows"), *(F.sum(F.greatest(F.size(n), F.lit(0))).alias(n) for n in (*lists, "provenance"))]
    raw = sources if raw is None else raw if "provenance" in raw.columns else raw.withColumn("provenance", F.array())
    many = raw.groupBy("entity_key").agg(*held).where(" OR ".join(f"{n} > {gather}" for n in ("_rows", *lists, "provenance"))).select("entity_key")
    few = dealt(sources, lambda rows: rows.join(F.broadcast(many), "entity_key", "left_anti"), "entity_key")
    large = sources.join(F.broadcast(many), "entity_key", "left_semi")
    counted = taken_apart(large, *(_items(sources, n, policy.rule(n)) for n in lists))
    over = counted.groupBy("entity_key", "kind", "key").count().groupBy("entity_key", "kind").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_one")).where(F.col("_n") > gather)
    none_over = lambda first: first.withColumn("_n", F.lit(None).cast("long"))
    left_out = lambda first: first.join(F.broadcast(over), ["entity_key", "kind"], "left").where("_n IS NULL OR key = _one")
    both = gathered(few, none_over).unionByName(gathered(large, left_out))
    had = [f"sort_array(transform(filter(_sources, x -> x.had_{n}), x -> named_struct('r', {rank(policy.rule(n).priority, 'x.source')}, 's', x.source))).s AS _{n}" for n in lists]
    out = _resolved(both, rules, scored, *had, "transform(_sources, x -> named_struct('source', x.source, 'prov', x.prov)) AS _given")

    once = "filter(certifications, (x, i) -> array_position(transform(certifications, y -> lower(trim(y.name))), lower(trim(x.name))) = i + 1)"
    report, kept = [], []
    for n in FIELDS:
        field = f"{key[n]}.%s" if n in PATHS else f"_{n}"
        conflict, contributing, chosen = (field % "conflict", field % "contributing", field % "value") if n in PATHS else ("false", field, f"to_json({n})")
        winner = f"coalesce({field % 'winner'}, get({contributing}, 0))" if n in PATHS else f"CASE WHEN size({n}) > 0 THEN get({field}, 0) END"
        report.append(f"named_struct('field', '{n}', 'strategy', '{policy.rule(n).strategy}', 'conflict', {conflict}, 'contributing', {contributing}, 'chosen', {chosen}, 'provenance', filter(_last, x -> x.field = '{bare(n)}'))")
        kept.append(f"get(filter(get(filter(_given, x -> x.source = {winner}), 0).prov, x -> x.field = '{bare(n)}'), 0)")
    contact = ", ".join(f"'{c}', contact_{c}.value" for c in CONTACT_FIELDS)
    some = " OR ".join(f"contact_{c}.value IS NOT NULL" for c in CONTACT_FIELDS)
    nameless = "first_name.value IS NULL OR last_name.value IS NULL"
    length = lambda n: f"size({once if n == 'certifications' else n})"
    faults = [f"CASE WHEN {nameless} THEN 'no source has a first and last name' END"]
    faults += [f"CASE WHEN array_contains(_over, '{n}') OR {length(n)} > {most} THEN '{n}: has more than {most} items' END" for n, most in MOST_ITEMS.items()]
    told = f"nullif(concat_ws('; ', {', '.join(faults)}), '')"
    return out.selectExpr(
        "entity_key", "regexp_replace(md5(entity_key), '^(.{8})(.{4})(.{4})(.{4})', '$1-$2-$3-$4-') AS id", *(f"{n}.value AS {n}" for n in SCALARS), f"CASE WHEN {some} THEN named_struct({contact}) END AS contact",
        *(f"{once} AS certifications" if n == "certifications" else n for n in STRUCTURED), *LISTS, f"array_compact(array({', '.join(kept)})) AS provenance", "'1.0' AS schema_version", "considered",
        f"array({', '.join(report)}) AS merge_report", f"{told} AS error_message",
    ).withColumn("error_type", F.when(F.col("error_message").isNotNull(), "MergeError"))


def disagreements(sources: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The rows of `conflicts` straight from the sources: lists never disagree, so they are not read."""
    policy = policy or Policy()
    fields = {n.replace(".", "_"): (F.col(p), policy.rule(n)) for n, p in PATHS.items()}
    scores = {k: F.expr(f"try_element_at(confidence.fields, '{n.removeprefix('contact.')}').score") for n, k in zip(PATHS, fields)} if "confidence" in sources.columns else None
    said = merge_scalars(sources, fields, scores)
    each = said.select("entity_key", F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"{k}.value").alias("chosen"), F.col(f"{k}.conflict").alias("conflict")) for n, k in zip(PATHS, fields))))).where("conflict")
    return each.select("entity_key", "field", "chosen", _told_of_conflict())


def _told_of_conflict() -> Column:
    return F.concat(F.lit("sources disagree on "), "field", F.lit("; kept "), "chosen").alias("message")


def conflicts(golden: DataFrame) -> DataFrame:
    """A row per disagreement: entity_key, field, chosen, message."""
    each = golden.select("entity_key", F.inline("merge_report")).where("conflict")
    return each.select("entity_key", "field", "chosen", _told_of_conflict())


def accessors(golden: DataFrame) -> DataFrame:
    """entity_key, merged_fields, conflicting, chosen (field -> value) and strategies (field -> strategy), from the report."""
    names = lambda test: F.transform(F.filter("merge_report", test), lambda x: x.field)
    pairs = lambda part: F.map_from_arrays(F.transform("merge_report", lambda x: x.field), F.transform("merge_report", lambda x: x[part]))
    return golden.select("entity_key", names(lambda x: x.field.isNotNull()).alias("merged_fields"), names(lambda x: x.conflict).alias("conflicting"), pairs("chosen").alias("chosen"), pairs("strategy").alias("strategies"))
