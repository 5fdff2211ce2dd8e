"""Data-quality checks from the declared keys, references and value rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonewatch.functions.grouped import cut_lineage
from stonewatch.sources.schema import TABLES, Table


def _key_text(key: Sequence[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in key))


def _violations(df: DataFrame, table: str, key: Sequence[str], rule: str | Column, reason) -> DataFrame:
    return df.select(
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
        F.lit(table).alias("table"),
        _key_text(key).alias("key"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
    )


def row_rules(df: DataFrame, table: str, key: Sequence[str], rules: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Rows breaking rules that look at one row only, all rules in one pass.

    `rules` maps a rule group to conditions by name; a NULL condition passes.
    """
    broken = [
        F.when(~F.expr(cond), F.struct(F.lit(group).alias("rule"), F.lit(name).alias("reason")))
        for group, named in rules.items()
        for name, cond in named.items()
    ]
    if not broken:
        return _violations(df.limit(0), table, key, "", "")
    found = df.select(_key_text(key).alias("_key"), F.explode(F.array_compact(F.array(*broken))).alias("_r"))
    return found.select(
        F.col("_r.rule").alias("rule"), F.lit(table).alias("table"), F.col("_key").alias("key"),
        F.col("_r.reason").alias("reason"),
    )


def null_rules(columns: Sequence[str]) -> dict[str, str]:
    return {f"{c} missing": f"`{c}` IS NOT NULL" for c in columns}


def length_rules(lengths: Mapping[str, int]) -> dict[str, str]:
    return {f"{c} too long": f"length(`{c}`) <= {n}" for c, n in lengths.items()}


def type_rules(table: Table) -> dict[str, str]:
    """Whether values of loosely typed rows fit the declared number types."""
    return {
        f"{c} out of range": f"`{c}` IS NULL OR try_cast(`{c}` AS {t.rstrip('?')}) IS NOT NULL"
        for c, t in table.columns.items()
        if t.startswith(("DECIMAL", "INT", "SMALLINT", "BIGINT"))
    }


def duplicate_keys(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Key values held by more than one row."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _violations(
        counts, table, key, "key", F.concat(F.col("_n").cast("string"), F.lit(" rows with this key"))
    )


def orphans(
    df: DataFrame, table: str, key: Sequence[str], columns: Sequence[str], parent: DataFrame,
    parent_table: str, parent_columns: Sequence[str],
) -> DataFrame:
    """Rows whose reference has no target; a reference with a NULL passes."""
    known = parent.select(*(F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)))
    here = [F.col(c).isNotNull() for c in columns]
    match = reduce(
        lambda a, b: a & b, (F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns))
    )
    rows = df.filter(reduce(lambda a, b: a & b, here)).join(known, match, "left_anti")
    return _violations(rows, table, key, "reference", f"no such {parent_table}")


def _unchecked(df: DataFrame, table: str, columns: Sequence[str], parent: str) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit("unchecked").alias("rule"),
        F.lit(table).alias("table"),
        F.lit(", ".join(columns)).alias("key"),
        F.lit(f"{parent} not given").alias("reason"),
    )


def table_violations(name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """All declared rules of one table; references to tables not given are listed as unchecked."""
    spec, df = TABLES[name], tables[name]
    parts = [
        row_rules(
            df,
            name,
            spec.key,
            _row_groups(spec),
        ),
        duplicate_keys(df, name, spec.key),
    ]
    for columns, parent, parent_columns in spec.refs:
        if parent in tables:
            parts.append(orphans(df, name, spec.key, columns, tables[parent], parent, parent_columns))
        else:
            parts.append(_unchecked(df, name, columns, parent))
    return reduce(DataFrame.unionByName, parts)


def _row_groups(spec: Table) -> dict[str, dict[str, str]]:
    return {
        "missing": null_rules(spec.required),
        "value": spec.checks,
        "length": length_rules(spec.lengths),
        "type": type_rules(spec),
    }


def _space(table: str, columns: Sequence[str]) -> str:
    return f"{table}({', '.join(columns)})"


def _value(columns: Sequence[str], types: Sequence[str]) -> Column:
    """Key values as text, spelt as the declared types spell them; NULL if one is missing."""
    spelt = [F.expr(f"try_cast(`{c}` AS {t.rstrip('?')})").cast("string") for c, t in zip(columns, types)]
    return F.concat(*(p for s in spelt for p in (F.length(s).cast("string"), F.lit(":"), s)))


def _facts(name: str, df: DataFrame, targets: set[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """What an audit needs of a table, in one pass over it: the row rules each row breaks, its key, the
    keys it refers to, and the values that others refer to."""
    spec = TABLES[name]

    def fact(kind: str, space: str = "", value: Column | None = None, rule: str = "", reason: str = "") -> Column:
        return F.struct(
            F.lit(kind).alias("fact"), F.lit(space).alias("space"), (F.lit("") if value is None else value).alias("value"),
            F.lit(rule).alias("rule"), F.lit(reason).alias("reason"),
        )

    def typed(table: str, columns: Sequence[str]) -> list[str]:
        return [TABLES[table].columns[c] for c in columns]

    found = [
        F.when(~F.expr(cond), fact("row", rule=group, reason=text))
        for group, named in _row_groups(spec).items()
        for text, cond in named.items()
    ]
    found.append(fact("key", name, _key_text(spec.key)))
    for columns, parent, parent_columns in spec.refs:
        value = _value(columns, typed(parent, parent_columns))
        found.append(F.when(value.isNotNull(), fact("ref", _space(parent, parent_columns), value, "reference", f"no such {parent}")))
    for columns in sorted(c for t, c in targets if t == name):
        value = _value(columns, typed(name, columns))
        found.append(F.when(value.isNotNull(), fact("target", _space(name, columns), value)))
    rows = df.select(_key_text(spec.key).alias("key"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select(F.lit(name).alias("table"), "key", "f.*")


def audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All declared rules of all tables given, types included, reading each table once.

    One pass turns a table's rows into facts, which are written; keys are counted and references
    looked up among those. A reference with a NULL passes; references to tables that are not
    given are listed as unchecked.
    """
    known = [n for n in tables if n in TABLES]
    targets = {(parent, tuple(columns)) for n in known for _, parent, columns in TABLES[n].refs if parent in tables}
    facts = cut_lineage(reduce(DataFrame.unionByName, (_facts(n, tables[n], targets) for n in known)))
    out = ["rule", "table", "key", "reason"]
    broken = facts.filter("fact = 'row'").select(*out)
    again = facts.filter("fact = 'key'").groupBy("table", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = again.select(
        F.lit("key").alias("rule"), "table", "key", F.concat(F.col("_n").cast("string"), F.lit(" rows with this key")).alias("reason")
    )
    given = sorted({_space(t, c) for t, c in targets})
    there = facts.filter("fact = 'target'").select("space", "value").distinct()
    lost = facts.filter((F.col("fact") == "ref") & F.col("space").isin(given)).join(there, ["space", "value"], "left_anti")
    found = broken.unionByName(again).unionByName(lost.select(*out))
    for n in known:
        for columns, parent, _ in TABLES[n].refs:
            if parent not in tables:
                found = found.unionByName(_unchecked(tables[n], n, columns, parent))
    return found


def check_rows(name: str, existing: DataFrame, candidates: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """New rows of a table with the first declared rule they break in `reason`.

    A candidate whose key exists, or that repeats an earlier candidate (by `seq`)
    with the same key, is refused. All tables referred to must be given.
    """
    spec = TABLES[name]
    missing = sorted({parent for _, parent, _ in spec.refs} - set(tables))
    if missing:
        raise ValueError(f"{name} refers to {', '.join(missing)}, which are not given")
    texts = [
        F.when(~F.expr(cond), F.lit(text))
        for text, cond in {
            **null_rules(spec.required), **spec.checks, **length_rules(spec.lengths),
        }.items()
    ]
    judged = candidates.withColumn("_row", F.coalesce(*texts))
    flags = [F.col("_row")]
    for i, (columns, parent, parent_columns) in enumerate(spec.refs):
        known = (
            tables[parent].select(*(F.col(p).alias(c) for p, c in zip(parent_columns, columns)))
            .distinct()
            .withColumn(f"_ref{i}", F.lit(True))
        )
        judged = judged.join(known, list(columns), "left")
        complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
        flags.append(F.when(F.col(f"_ref{i}").isNull() & complete, F.lit(f"no such {parent}")))
    held = existing.select(*spec.key).distinct().withColumn("_held", F.lit(True))
    judged = judged.join(held, list(spec.key), "left")
    flags.append(F.when(F.col("_held"), F.lit("key exists")))
    judged = judged.withColumn("_alone", F.coalesce(*flags))
    first = (
        judged.filter(F.col("_alone").isNull()).groupBy(*spec.key).agg(F.min("seq").alias("_first"))
    )
    return (
        judged.join(first, list(spec.key), "left")
        .withColumn(
            "reason",
            F.coalesce("_alone", F.when(F.col("_first") < F.col("seq"), F.lit("key exists"))),
        )
        .select(*candidates.columns, "reason")
    )
