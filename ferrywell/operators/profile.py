"""Profiling and discovery: column facts, quality issues, watermark and key candidates."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.functions import text
from ferrywell.operators.cleaning import (
    COPIES, all_null, column, count_copies, literal, null_tokens, quoted, trim_cells,
)

SHARE = 0.85
# Name parts that hint at a change column or a creation column.
CHANGE_NAMES = ["updated", "modified", "changed", "last_", "update_dt", "mod_"]
CREATION_NAMES = ["created", "insert", "added"]


SAMPLE_ROWS = 3


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """A few rows of the table as they come, beside the profile of its columns."""
    return df.limit(n)


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column with its type, beside the size of the table; ``sample_rows`` shows what is in them."""
    fields = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"))
        for i, f in enumerate(df.schema)
    ]
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(fields)).alias("total_columns"), F.inline(F.array(*fields))
    )


def _as_text(c: str, kind: T.DataType) -> str:
    """Text form that does not depend on the engine's way of printing numbers and times.

    A float is written in full with at most ten decimals where that is the same number, else as Spark prints it.
    """
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        plain = f"try_cast({c} as decimal(38,10))"
        return f"if(cast({plain} as double) = cast({c} as double), cast({plain} as string), cast({c} as string))"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    return f"cast({c} as string)"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def _declared(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact (column_name, distinct_values).

    One branch per column, so that each scans only its own column and hot values merge before
    the shuffle; a single aggregate over all columns would copy every row once per column.
    """
    parts = [
        df.agg(F.count_distinct(column(f.name)).alias("distinct_values")).select(
            F.lit(f.name).alias("column_name"), "distinct_values"
        )
        for f in df.schema
        if _orderable(f.dataType)
    ]
    return reduce(DataFrame.unionByName, parts)


def _text_tests(c: str) -> dict[str, str]:
    """Conditions under which a text counts as a datetime, date, boolean or number, in that order."""
    return {
        "datetime": f"{c} rlike {literal(text.DATETIME_PATTERN)}",
        "date": f"{c} rlike {literal(text.DATE_PATTERN)}",
        "boolean": f"lower({c}) in ({', '.join(literal(w) for w in text.BOOLEAN_WORDS)})",
        "number": text.looks_numeric_sql(c),
    }


def _measures_and_facts(schema: T.StructType, distinct: str | None) -> tuple[dict[str, str], list[str]]:
    """What one pass measures, by name, and what a profile's rows make of it. ``distinct`` is the form of the estimate."""
    measures, facts = {"rows": "count(1)"}, []
    for i, f in enumerate(schema):
        c, kind = quoted(f.name), f.dataType
        measures[f"n{i}"] = f"count({c})"
        fact = {
            "column_name": literal(f.name),
            "declared_type": literal(kind.simpleString()),
            "total_rows": "rows",
            "null_rows": f"rows - n{i}",
            "distinct_values": "cast(null as bigint)",
            "min_value": "cast(null as string)",
            "max_value": "cast(null as string)",
            **{f"{k}_share": "cast(null as decimal(5,4))" for k in _text_tests(c)},
            "detected_type": literal(_declared(kind)),
        }
        if _orderable(kind):
            measures |= {f"a{i}": f"min({c})", f"z{i}": f"max({c})"}
            fact |= {"min_value": _as_text(f"a{i}", kind), "max_value": _as_text(f"z{i}", kind)}
            if distinct is not None:
                measures[f"d{i}"] = distinct.format(c=c, text=f"cast({c} as string)")
                fact["distinct_values"] = f"d{i}"
        if isinstance(kind, T.StringType):
            for k, test in _text_tests(c).items():
                measures[f"{k}{i}"] = f"count_if({test})"
                fact[f"{k}_share"] = f"cast(try_divide({k}{i}, n{i}) as decimal(5,4))"
            # zeros and ones alone are numbers
            measures[f"digits{i}"] = f"count_if({c} in ('0', '1'))"
            enough = {k: f"n{i} > 0 and {k}{i} >= {SHARE} * n{i}" for k in _text_tests(c)}
            enough["boolean"] += f" and digits{i} <> boolean{i}"
            cases = " ".join(f"when {test} then '{k}'" for k, test in enough.items())
            fact["detected_type"] = f"case {cases} else 'string' end"
        facts.append(_struct(fact))
    return measures, facts


def _aggregated(df: DataFrame, measures: dict[str, str]) -> DataFrame:
    return df.agg(*[F.expr(f"{measure} as {name}") for name, measure in measures.items()])


def profile_columns(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: nulls, distinct values, range, shares per kind of text, detected type.

    Everything but the exact distinct counts comes from one pass. ``exact=False`` estimates
    them in that pass, which is what a very large table calls for.
    """
    measures, facts = _measures_and_facts(df.schema, None if exact else "approx_count_distinct({c})")
    profile = _aggregated(df, measures).selectExpr(f"inline(array({', '.join(facts)}))")
    if not exact:
        return profile
    names = profile.columns
    return profile.drop("distinct_values").join(distinct_counts(df), "column_name", "left").select(*names)


#: Registers of a stored sketch as a power of two: its estimate is off by about 1.6 % (one standard error), whatever the table's size.
SKETCH_BITS = 12


def profile_state(df: DataFrame) -> DataFrame:
    """One row with all that the profile of a batch needs: counts, ranges and a sketch of each column's values.

    It has a fixed size, so the states of a growing table are kept instead of reading the table again.
    """
    measures, _ = _measures_and_facts(df.schema, f"hll_sketch_agg({{text}}, {SKETCH_BITS})")
    return _aggregated(df, measures)


def profile_of_states(states: DataFrame, schema: T.StructType) -> DataFrame:
    """The profile of all batches together, from their states: exact but for the distinct values, which are estimated.

    States merge in any order and grouping: counts add up, ranges widen, sketches are united.
    """
    measures, facts = _measures_and_facts(schema, "{c}")
    merged = {}
    for name in measures:
        kind = name.rstrip("0123456789")
        merged[name] = {"a": f"min({name})", "z": f"max({name})", "d": f"coalesce(hll_sketch_estimate(hll_union_agg({name})), 0L)"}.get(
            kind, f"coalesce(sum({name}), 0L)")
    return _aggregated(states, merged).selectExpr(f"inline(array({', '.join(facts)}))")


def add_state(batch: DataFrame, path: str, name: str) -> None:
    """Store a batch's state under its name; a batch that comes again replaces its own state and counts once."""
    profile_state(batch).write.mode("overwrite").parquet(f"{path}/batch={name}")


def stored_profile(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return profile_of_states(spark.read.parquet(path).drop("batch"), schema)


def _quality_counts(df: DataFrame) -> DataFrame:
    """Rows, surplus copies and missing cells per column, from one grouping of identical rows."""
    grouped = count_copies(null_tokens(trim_cells(df), "strict", trimmed=True))
    body = grouped.drop(COPIES)
    copies = F.col(COPIES)
    return grouped.agg(
        F.sum(copies).alias("rows"),
        F.sum(F.when(all_null(body), 0).otherwise(copies - 1)).alias("duplicate_rows"),
        *[F.sum(F.when(column(c).isNull(), copies).otherwise(0)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )


def quality_issues(df: DataFrame) -> DataFrame:
    """(issue, column_name, affected_rows, severity) for missing values and duplicate rows."""
    issues = [
        F.struct(F.lit("missing values").alias("issue"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("affected_rows"))
        for i, c in enumerate(df.columns)
    ]
    issues.append(
        F.struct(
            F.lit("duplicate rows").alias("issue"),
            F.lit(None).cast("string").alias("column_name"),
            F.col("duplicate_rows").alias("affected_rows"),
        )
    )
    share = F.col("affected_rows") / F.col("rows")
    return (
        _quality_counts(df)
        .select("rows", F.inline(F.array(*issues)))
        .where(F.col("affected_rows") > 0)
        .withColumn("severity", F.when(share >= 0.20, "high").when(share >= 0.05, "medium").otherwise("low"))
        .drop("rows")
    )


def quality_score(df: DataFrame) -> DataFrame:
    """0 to 100: the share of filled cells times the share of rows that are no surplus copies."""
    nulls = reduce(Column.__add__, [F.col(f"n{i}") for i in range(len(df.columns))])
    cells = F.col("rows") * len(df.columns)
    score = 100 * (1 - F.try_divide(F.col("null_cells"), F.col("cells"))) * (
        1 - F.try_divide(F.col("duplicate_rows"), F.col("rows"))
    )
    return (
        _quality_counts(df)
        .select("rows", cells.alias("cells"), nulls.alias("null_cells"), "duplicate_rows")
        .withColumn("score", F.round(score, 2).cast("decimal(5,2)"))
    )


def _watermark_score(name: str, kind: str) -> int:
    score = 10 if any(k in kind for k in ("timestamp", "datetime", "date")) else 0
    score += 5 if any(k in name.lower() for k in CHANGE_NAMES) else 0
    return score + (2 if any(k in name.lower() for k in CREATION_NAMES) else 0)


def watermark_candidates(df: DataFrame, top: int = 5) -> DataFrame:
    """The best columns to load incrementally by, with their nulls and highest value."""
    scored = [(f, _watermark_score(f.name, f.dataType.simpleString())) for f in df.schema]
    best = sorted((x for x in scored if x[1] > 0), key=lambda x: -x[1])[:top]
    if not best:
        return df.sparkSession.createDataFrame(
            [], "rank int, column_name string, column_type string, score int, null_rows bigint, max_value string"
        )
    measures, facts = [F.count(F.lit(1)).alias("rows")], []
    for i, (f, score) in enumerate(best):
        measures += [F.count(column(f.name)).alias(f"n{i}"), F.max(column(f.name)).alias(f"z{i}")]
        facts.append(
            F.struct(
                F.lit(i + 1).alias("rank"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                F.lit(score).alias("score"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_rows"),
                F.expr(_as_text(f"z{i}", f.dataType)).alias("max_value"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*facts)))


#: One value in so many, chosen by its hash, is looked at before the full test: a repeat there already refutes a key.
PROBED = 64
#: Where such a share is still large, one in so many is looked at before.
PROBED_FIRST, LARGE_SHARE = 4096, 1 << 13
#: Columns of at most about so many values are counted first; their groups merge before the shuffle.
FEW = 1 << 16
#: Tuples of a partition in the full test, and the share of all rows from which on one value counts as heavy.
TESTED_TUPLES, HEAVY_SHARE = 1_000_000, 1 / 128
Candidate = tuple[str, ...]
Found = dict[Candidate, tuple[int, bool]]


def _repeats(df: DataFrame, candidates: list[Candidate], one_in: int = 1, many: dict[str, int] | None = None) -> Found:
    """Of each candidate the number of different tuples, and whether none repeats; one scan and one shuffle for all.

    Every column is hashed once with each of two seeds, a tuple by the hashes of its columns; equal tuples
    meet in a group of 128 bits, most of them before the shuffle. With ``one_in`` a candidate sees only a share of
    the values of its column that has the most. All copies of a tuple are then there or none, so a repeat is certain.
    """
    if not candidates:
        return {}
    names = sorted({c for chosen in candidates for c in chosen})
    number = {c: i for i, c in enumerate(names)}
    hashes = [f"xxhash64({seed}{quoted(c)}) as {kind}{i}" for c, i in number.items() for kind, seed in (("x", ""), ("y", "1, "))]
    sets: dict[str, list[str]] = {}
    for k, chosen in enumerate(candidates):
        x, y = (", ".join(f"{kind}{number[c]}" for c in chosen) for kind in "xy")
        test = "true" if one_in == 1 else f"pmod(x{number[max(chosen, key=lambda c: many[c])]}, {one_in}) = 0"
        sets.setdefault(test, []).append(f"named_struct('candidate', {k}, 'h1', xxhash64({x}), 'h2', xxhash64({y}))")
    nothing = "cast(array() as array<struct<candidate: int, h1: bigint, h2: bigint>>)"
    tuples = ", ".join(f"if({test}, array({', '.join(each)}), {nothing})" for test, each in sets.items())
    hashed = df.selectExpr(*hashes).where(" or ".join(sets))
    groups = hashed.selectExpr(f"inline(concat({tuples}))").groupBy("candidate", "h1", "h2").agg(F.expr("count(1) as n"))
    found = groups.groupBy("candidate").agg(F.expr("count(1) as tuples"), F.expr("max(n) = 1 as is_key")).collect()
    return {candidates[r["candidate"]]: (r["tuples"], r["is_key"]) for r in found}


def _tested(df: DataFrame, candidates: list[Candidate], total: int, many: dict[str, int], one_in: int = 1) -> Found:
    """As ``_repeats``, of a large table and without a shuffle of the tuples of each candidate.

    Candidates share the column with the most values. The rows are dealt out by it once, with the columns
    that those candidates have, and their tuples are grouped where the rows lie. Rows of a value that is so
    frequent that it would burden one task go by their tuples instead.
    """
    if not candidates:
        return {}
    if total <= TESTED_TUPLES:
        return _repeats(df, candidates, one_in, many)
    shared: dict[str, list[Candidate]] = {}
    for chosen in candidates:
        shared.setdefault(max(chosen, key=lambda c: many[c]), []).append(chosen)
    hashes = [F.xxhash64(column(w)) for w in shared]
    row = df.agg(*[F.expr(f"approx_top_k(xxhash64({quoted(w)}), 128, 4096) as t{i}") for i, w in enumerate(shared)]).first()
    found: Found = {}
    for i, ((w, group), x) in enumerate(zip(shared.items(), hashes, strict=True)):
        names = sorted({c for chosen in group for c in chosen})
        rows = df.where(F.pmod(x, F.lit(one_in)) == 0).select(*[column(c) for c in names])
        heavy = [t["item"] for t in row[f"t{i}"] if t["count"] > total * HEAVY_SHARE]
        dealt = (rows.where(~x.isin(heavy)) if heavy else rows).repartition(
            -(-total * len(group) // (one_in * TESTED_TUPLES)), column(w))
        tuples = [F.struct(F.lit(k).alias("candidate"), F.xxhash64(*map(column, chosen)).alias("h1"),
                           F.xxhash64(F.lit(1), *map(column, chosen)).alias("h2")) for k, chosen in enumerate(group)]
        # grouped by the shared column too, so that nothing is dealt out again
        groups = dealt.select(column(w).alias("shared"), F.inline(F.array(*tuples))).groupBy("shared", "candidate", "h1", "h2")
        counts = groups.agg(F.expr("count(1) as n")).groupBy("candidate").agg(F.expr("count(1) as tuples"), F.expr("max(n) = 1 as is_key"))
        there = {group[r["candidate"]]: (r["tuples"], r["is_key"]) for r in counts.collect()}
        others = _repeats(rows.where(x.isin(heavy)), group) if heavy else {}
        for chosen in there.keys() | others.keys():
            (n, unique), (m, also) = there.get(chosen, (0, True)), others.get(chosen, (0, True))
            found[chosen] = (n + m, unique and also)
        del rows, dealt, groups, counts
        df.sparkSession.sparkContext._jvm.System.gc()  # the rows that were dealt out may go
    return found


def _screened(df: DataFrame, candidates: list[Candidate]) -> tuple[int, list[int], dict[str, int]]:
    """Rows, the nulls of each candidate, and an estimate of each column's values, which decides cost only."""
    names = sorted({c for chosen in candidates for c in chosen})
    measures = ["count(1) as rows"] + [f"approx_count_distinct({quoted(c)}) as d{i}" for i, c in enumerate(names)]
    for i, chosen in enumerate(candidates):
        measures.append(f"count_if({' or '.join(f'{quoted(c)} is null' for c in chosen)}) as n{i}")
    row = df.agg(*[F.expr(m) for m in measures]).first()
    many = {c: row[f"d{i}"] for i, c in enumerate(names)}
    return row["rows"], [row[f"n{i}"] for i in range(len(candidates))], many


def _refuted(df: DataFrame, candidates: list[Candidate], total: int, many: dict[str, int]) -> set[Candidate]:
    """Candidates for which two rows agree, as far as a share of the rows shows it."""
    first = PROBED_FIRST if total // PROBED > LARGE_SHARE else PROBED
    refuted = {c for c, (_, unique) in _repeats(df, candidates, first, many).items() if not unique} if candidates else set()
    left = [c for c in candidates if c not in refuted]
    if left and first > PROBED:
        refuted |= {c for c, (_, unique) in _tested(df, left, total, many, PROBED).items() if not unique}
    return refuted


def _too_few(df: DataFrame, names: list[str], total: int, many: dict[str, int]) -> tuple[Found, dict[str, int]]:
    """The test of the columns with few values, and the most values that each column can have."""
    few = [(c,) for c in names if many[c] <= FEW]
    found = _repeats(df, few) if few else {}
    return found, {c: found[(c,)][0] if (c,) in found else total for c in names}


def key_candidates(df: DataFrame, given: list[list[str]] = ()) -> DataFrame:
    """Which single columns and given combinations are unique and free of nulls.

    Nulls rule a candidate out in the first pass, a repeat among a share of the tuples in the second; what
    is left is tested in full, all in one pass. No estimate decides.
    """
    candidates = [(f.name,) for f in df.schema if _orderable(f.dataType)] + [tuple(c) for c in given]
    total, nulls, many = _screened(df, candidates)
    filled = [c for c, n in zip(candidates, nulls, strict=True) if total and not n]
    tested, most = _too_few(df, sorted({c for chosen in filled for c in chosen}), total, many)
    open_ = [c for c in filled if c not in tested and prod(most[n] for n in c) >= total]
    refuted = _refuted(df, open_, total, many)
    tested |= _tested(df, [c for c in open_ if c not in refuted], total, many)
    rows = [(", ".join(c), total, n, c in tested and tested[c][1]) for c, n in zip(candidates, nulls, strict=True)]
    return df.sparkSession.createDataFrame(rows, "key_columns string, total_rows bigint, null_rows bigint, is_key boolean")


def key_lattice(df: DataFrame, up_to: int = 3) -> DataFrame:
    """The smallest sets of up to so many columns that are unique and free of nulls.

    Columns of few values are counted first; sets whose columns have too few values between them to tell all
    rows apart need no test. Of the others the largest are probed: what repeats there repeats in all subsets
    too, so most of the lattice needs no test. Then each level is tested, without supersets of a key, which
    need none. The number of scans grows with the columns, not with the rows.
    """
    names = [f.name for f in df.schema if _orderable(f.dataType)]
    total, nulls, many = _screened(df, [(c,) for c in names])
    filled = [c for c, n in zip(names, nulls, strict=True) if total and not n]
    up_to = min(up_to, len(filled))
    known, most_of = _too_few(df, filled, total, many)
    values = {frozenset(c): n for c, (n, _) in known.items()}
    keys: list[set[str]] = [set(c) for c, (_, unique) in known.items() if unique and up_to]

    def enough(c: Candidate) -> bool:
        return prod(most_of[n] for n in c) >= total

    def passed(c: Candidate) -> bool:
        return any(key <= set(c) for key in keys)

    wide = [c for c in combinations(filled, up_to) if enough(c) and not passed(c)] if up_to else []
    refuted = [set(c) for c in _refuted(df, wide, total, many)]
    for size in range(1, up_to + 1):
        open_ = []
        for c in combinations(filled, size):
            if enough(c) and c not in known and not passed(c) and not any(set(c) <= wide for wide in refuted):
                most = min((values[frozenset(c[:i])] * values[frozenset(c[i:])] for i in range(1, size)
                            if frozenset(c[:i]) in values and frozenset(c[i:]) in values), default=total)
                if most >= total:
                    open_.append(c)
        for c, (n, unique) in _tested(df, open_, total, many).items():
            values[frozenset(c)] = n
            if unique:
                keys.append(set(c))
    rows = [(", ".join(c for c in filled if c in key), len(key), total) for key in keys]
    return df.sparkSession.createDataFrame(rows, "key_columns string, n_columns int, total_rows bigint")
