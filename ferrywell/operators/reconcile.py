"""Proof that a target holds what its source holds: row counts, column sums and checksums of the other columns.

The expressions are SQL text: a table may have hundreds of columns to sum, and one text is built
far faster than the same expression from hundreds of Column objects.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.operators.cleaning import literal, numeric_columns, quoted

TOLERANCE = Decimal("0.01")

# Whole numbers, and the whole parts of floats, are summed in two halves of 32 bits: per task two
# long sums cannot overflow, and long sums are several times faster than decimal ones. The rest of a
# float is summed in billionths, and what rounding to them loses is summed as a double, which the
# verdict takes into account. Decimals are summed at their own scale.
HALF = 1 << 32
PARTS = 1_000_000_000
WHOLE = "9.2e18D"  # floats from here on have no long whole part


def _in_target(names: list[str], target: DataFrame, kind: str) -> list[tuple[str, str]]:
    """Source columns with their target columns, names compared without case."""
    there = {c.lower(): c for c in target.columns}
    missing = [c for c in names if c.lower() not in there]
    if missing:
        raise ValueError(f"target lacks the {kind} {missing}")
    return [(c, there[c.lower()]) for c in names]


def _compared_columns(source: DataFrame, target: DataFrame) -> list[tuple[str, str]]:
    return _in_target(numeric_columns(source), target, "numeric columns")


def _content_columns(source: DataFrame, target: DataFrame) -> list[tuple[str, str]]:
    """The columns that no sum covers: texts, times, truth values, bytes and nested values."""
    summed = set(numeric_columns(source))
    return _in_target([c for c in source.columns if c not in summed], target, "columns")


def _same_form(names: tuple[str, str], kinds: tuple[T.DataType, T.DataType]) -> list[str]:
    """SQL for a value on either side, equal where the values are, whatever the exact types."""
    forms = []
    for name, kind in zip(names, kinds, strict=True):
        c = quoted(name)
        if isinstance(kind, T.IntegralType):
            forms.append(f"cast({c} as bigint)")
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            forms.append(f"cast({c} as double)")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            forms.append(f"to_json(named_struct('v', {c}))")
        else:
            forms.append(c)
    plain = [type(k) for k in kinds]
    if plain[0] != plain[1] and not all(issubclass(k, T.IntegralType) for k in plain) and not all(issubclass(k, (T.FloatType, T.DoubleType)) for k in plain):
        forms = [f"cast({form} as string)" for form in forms]
    elif isinstance(kinds[0], T.DecimalType) and kinds[0] != kinds[1]:
        forms = [f"cast({form} as decimal(38,{max(k.scale for k in kinds)}))" for form in forms]
    return forms


def _row_hashes(forms: list[str]) -> tuple[str, str]:
    """Two hashes of a row; a null counts by its place, which the hash functions would pass over."""
    values = ", ".join(f"isnull({form}), {form}" for form in forms)
    return f"xxhash64({values})", f"xxhash64(1, {values})"


# Checksums of rows: the halves of both hashes, summed in any order. Equal bags of rows have equal sums; others
# agree by a chance of one in 2^128.
CHECKSUMS = [f"{half.format(h)} as {h}{k}" for h in ("ha", "hb") for k, half in enumerate(("shiftrightunsigned({0}, 32)", f"{{0}} & {HALF - 1}"))]
SUMS = ["ha0", "ha1", "hb0", "hb1"]


def _parts(c: str, kind: T.DataType) -> tuple[list[str], str, str, str | None]:
    """Values to sum per row as p0, p1, .., what they add up to, the test for a value that no sum can hold, and what rounding loses."""
    if isinstance(kind, T.DecimalType):
        return [c], f"try_cast({{0}} as decimal(38,{kind.scale}))", "false", None
    if isinstance(kind, T.IntegralType):
        whole = f"cast({c} as bigint)"
        return ([f"shiftright({whole}, 32)", f"{whole} & {HALF - 1}"],
                f"try_cast(cast({{0}} as decimal(28,0)) * {HALF} + {{1}} as decimal(38,0))", "false", None)
    fits = f"abs({c}) < {WHOLE}"  # false for NaN, which is greater than all numbers
    whole = f"case when {fits} then cast(floor({c}) as bigint) end"
    fraction = f"(cast({c} as double) - floor({c}))"
    rest = f"case when {fits} then cast(rint({fraction} * {PARTS}) as bigint) end"
    residue = f"case when {fits} then {fraction} - rint({fraction} * {PARTS}) / {PARTS}D end"
    total = (f"try_cast(cast({{0}} as decimal(28,0)) * {HALF} + {{1}} as decimal(27,0)) "
             f"+ cast(cast({{2}} as decimal(20,0)) / {PARTS} as decimal(27,9))")
    return [f"shiftright({whole}, 32)", f"{whole} & {HALF - 1}", rest], f"try_cast({total} as decimal(38,9))", f"not ({fits})", residue


def _unfit(c: str, kind: T.DataType) -> str | None:
    """For a float that no sum can hold, half its hash, so that equal ones on both sides can be told."""
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return None
    return f"case when not (abs({c}) < {WHOLE}) then xxhash64(cast({c} as double)) & {HALF - 1} else 0L end"


def _per_task(raw: DataFrame, kinds: list[T.DataType], hashed: int, by: list[str]) -> DataFrame:
    """A small row per scanning task, so that the long sums stay short: sums, filled cells, lost values, residues, checksums.

    The raw rows hold the columns to sum as c0, c1, .. and the forms to be hashed as f0, f1, ..
    """
    values, measures, totals = ["spark_partition_id() as __task"], ["count(1) as rows"], ["rows"]
    if hashed:
        values += [f"{h} as {n}" for h, n in zip(_row_hashes([f"f{j}" for j in range(hashed)]), ("ha", "hb"), strict=True)]
        measures += [f"sum({part.partition(' as ')[0]}) as {part.partition(' as ')[2]}" for part in CHECKSUMS]
        totals += [f"cast({c} as decimal(38,0)) as {c}" for c in SUMS]
    for i, kind in enumerate(kinds):
        c = f"c{i}"
        parts, total, lost, residue = _parts(c, kind)
        sums = [f"p{i}_{k}" for k in range(len(parts))]
        values += [f"{part} as {p}" for part, p in zip(parts, sums, strict=True)]
        values += [f"{c} is not null as n{i}", f"coalesce({lost}, false) as x{i}"]
        measures += [f"try_sum({p}) as {p}" for p in sums]
        measures += [f"count_if(n{i}) as n{i}", f"count_if(x{i}) as x{i}"]
        totals += [f"{total.format(*sums)} as v{i}", f"n{i}", f"x{i}"]
        if residue:
            values += [f"{residue} as r{i}", f"{_unfit(c, kind)} as u{i}"]
            measures += [f"sum(r{i}) as r{i}", f"sum(u{i}) as u{i}"]
            totals += [f"r{i}", f"cast(u{i} as decimal(38,0)) as u{i}"]
    return raw.selectExpr(*by, *values).groupBy(*by, "__task").agg(*[F.expr(m) for m in measures]).selectExpr(*by, *totals)


def _found(tag: str, kinds: list[T.DataType], hashed: int, only: str = "") -> list[str]:
    """What the tasks of one side add up to. Lost are NaN, infinite and too large floats, and a sum that overflows."""
    found = [f"coalesce(sum(rows){only}, 0L) as {tag}_rows"]
    if hashed:
        found.append(f"array({', '.join(f'coalesce(sum({c}){only}, 0)' for c in SUMS)}) as {tag}_content")
    for i, kind in enumerate(kinds):
        rounded = isinstance(kind, (T.FloatType, T.DoubleType))
        found += [f"{f'coalesce(sum(r{i}){only}, 0D)' if rounded else '0D'} as {tag}_r{i}",
                  f"{f'coalesce(sum(u{i}){only}, 0)' if rounded else '0'} as {tag}_u{i}",
                  f"coalesce(try_sum(v{i}){only}, 0) as {tag}_v{i}",
                  f"coalesce(sum(x{i} + if(n{i} > x{i} and v{i} is null, 1L, 0L)){only}, 0L) "
                  f"+ if(count(v{i}){only} > 0 and try_sum(v{i}){only} is null, 1L, 0L) as {tag}_x{i}"]
    return found


def _shape(kind: T.DataType) -> tuple:
    """How a column is summed."""
    if isinstance(kind, T.DecimalType):
        return "decimal", kind.scale
    return ("whole",) if isinstance(kind, T.IntegralType) else ("float",)


def _raw(df: DataFrame, names: list[str], forms: list[str]) -> DataFrame:
    return df.selectExpr(*[f"{quoted(c)} as c{i}" for i, c in enumerate(names)], *[f"{form} as f{j}" for j, form in enumerate(forms)])


def _forms(source: DataFrame, target: DataFrame, names: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """The comparable forms of these columns on either side."""
    both = [_same_form(pair, (source.schema[pair[0]].dataType, target.schema[pair[1]].dataType)) for pair in names]
    return [a for a, _ in both], [b for _, b in both]


def _totals(
    source: DataFrame, target: DataFrame, pairs: list[tuple[str, str]], content: list[tuple[str, str]] = ()
) -> DataFrame:
    """One row with the counts, sums, losses and checksums of both sides.

    Columns of like types are summed side by side in one plan, which is built and compiled once.
    """
    a, b = _forms(source, target, list(content))
    here, there = _raw(source, [x for x, _ in pairs], a), _raw(target, [y for _, y in pairs], b)
    kinds, others = ([df.schema[f"c{i}"].dataType for i in range(len(pairs))] for df in (here, there))
    if list(map(_shape, kinds)) == list(map(_shape, others)):
        both = here.withColumn("side", F.lit("s")).union(there.withColumn("side", F.lit("t")))
        kinds = [both.schema[f"c{i}"].dataType for i in range(len(pairs))]
        tasks = _per_task(both, kinds, len(a), ["side"])
        found = _found("s", kinds, len(a), " filter (where side = 's')") + _found("t", kinds, len(a), " filter (where side = 't')")
        return tasks.agg(*[F.expr(f) for f in found])
    sides = [_per_task(df, k, len(a), []).agg(*[F.expr(f) for f in _found(tag, k, len(a))])
             for df, k, tag in ((here, kinds, "s"), (there, others, "t"))]
    return sides[0].withColumn("__one", F.lit(1)).join(sides[1].withColumn("__one", F.lit(1)), "__one").drop("__one")


COUNT_CHECKS = [
    "s_rows as source_rows",
    "t_rows as target_rows",
    "s_rows = t_rows as row_count_match",
    "abs(s_rows - t_rows) as row_count_diff",
]


def _sum_checks(pairs: list[tuple[str, str]], tolerance: Decimal, unsummed: set[str]) -> str:
    """An array with one struct per compared column; sums are given as text, since each has its own scale."""
    def kept(i: int, name: str) -> str:
        return "true" if name in unsummed else f"s_x{i} = 0 and t_x{i} = 0"

    checks = []
    for i, (name, _) in enumerate(pairs):
        s, t = f"s_v{i}", f"t_v{i}"
        # as a double, since a decimal of 38 digits leaves the tolerance no room for its own
        near = f"coalesce(abs(cast(try_subtract({s}, {t}) as double) + (s_r{i} - t_r{i})) < {tolerance}D, false)"
        checks.append(
            f"named_struct('column_name', {literal(name)}, 'source_sum', cast({s} as string), 'target_sum', cast({t} as string), "
            f"'source_lost', s_x{i}, 'target_lost', t_x{i}, "
            f"'sum_match', {near} and {kept(i, name)} and s_x{i} = t_x{i} and s_u{i} = t_u{i})"
        )
    return f"array({', '.join(checks)})"


def _unsummed(df: DataFrame, allowed: bool) -> set[str]:
    return {f.name for f in df.schema if allowed and isinstance(f.dataType, (T.FloatType, T.DoubleType))}


def reconcile_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    return _totals(source, target, []).selectExpr(*COUNT_CHECKS)


def reconcile_sums(
    source: DataFrame, target: DataFrame, tolerance: Decimal = TOLERANCE, unsummed: bool = False
) -> DataFrame:
    """Per numeric column the sums of both sides, the values left out of them, and whether they match.

    They match if they differ by less than the tolerance and no value was left out on either side. With
    ``unsummed``, NaN, infinite and very large floats may be left out when both sides hold the same ones, which a checksum tells. The sums of
    floats are shown in billionths; what each row loses by that is not shown, but counts towards the difference.
    """
    pairs = _compared_columns(source, target)
    if not pairs:
        raise ValueError("the source has no numeric column to sum")
    return _totals(source, target, pairs).selectExpr(f"inline({_sum_checks(pairs, tolerance, _unsummed(source, unsummed))})")


def reconcile(
    source: DataFrame, target: DataFrame, tolerance: Decimal = TOLERANCE, unsummed: bool = False
) -> DataFrame:
    """Counts, sums and checksums in one pass over each side.

    Columns that cannot be summed count by a checksum of their rows, which does not depend on the order of
    rows; ``changed_buckets`` says where they differ. Without a column of a kind there is no verdict on it.
    """
    pairs, content = _compared_columns(source, target), _content_columns(source, target)
    failed = f"size(filter({_sum_checks(pairs, tolerance, _unsummed(source, unsummed))}, c -> not c.sum_match))" if pairs else "0"
    checked = _totals(source, target, pairs, content).selectExpr(
        *COUNT_CHECKS, f"{len(pairs)} as checked_columns", f"{failed} as failed_columns", f"{len(content)} as content_columns",
        f"{'s_content = t_content' if content else 'cast(null as boolean)'} as content_match",
    )
    passed = "failed_columns = 0" if pairs else "cast(null as boolean)"
    return checked.selectExpr(
        "*", f"{passed} as sums_passed", f"row_count_match and {passed} and coalesce(content_match, true) as overall_passed"
    )


def changed_buckets(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None, buckets: int = 1024,
    bucket: str | None = None,
) -> DataFrame:
    """Buckets of keys whose rows differ: lost, added, repeated or changed, in any of the columns.

    By default the columns that no sum covers are compared. Keys are dealt into buckets by hash, or by an
    expression over them; with their rows the few differing buckets can then be compared in full. Each side
    is read once and shrinks to a row per task and bucket before the shuffle.
    """
    names = [c for c, _ in _content_columns(source, target)] if columns is None else columns
    pairs = _in_target([*keys, *(c for c in names if c not in keys)], target, "columns")
    sides = []
    for df, tag, forms in zip((source, target), "st", _forms(source, target, pairs), strict=True):
        dealt = f"pmod(xxhash64({', '.join(forms[:len(keys)])}), {buckets})" if bucket is None else bucket
        rows = df.selectExpr(f"cast({dealt} as bigint) as bucket", "spark_partition_id() as task",
                             *[f"{h} as {n}" for h, n in zip(_row_hashes(forms), ("ha", "hb"), strict=True)])
        tasks = rows.groupBy("bucket", "task").agg(
            F.expr("count(1) as rows"), *[F.expr(f"sum({part.partition(' as ')[0]}) as {part.partition(' as ')[2]}") for part in CHECKSUMS])
        sums = ", ".join(f"sum(cast({c} as decimal(38,0)))" for c in SUMS)
        sides.append(tasks.groupBy(F.coalesce("bucket", F.lit(-1)).alias("bucket")).agg(
            F.expr(f"sum(rows) as {tag}_rows"), F.expr(f"array({sums}) as {tag}_content")))
    both = sides[0].join(sides[1], "bucket", "full_outer")
    return both.where("not (s_content <=> t_content)").selectExpr(
        "bucket", "coalesce(s_rows, 0L) as source_rows", "coalesce(t_rows, 0L) as target_rows")
