"""Breaks one rule at a time and shows that its query then differs from the SQL.

Run by hand: ``python tests/mutations.py <sf dir> [query ...]``. Works on a copy of the repository.
"""

from __future__ import annotations

import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CELLS, POSITIONS = "operators/cells.py", "functions/positions.py"
CLEANING, CDC, LOADS = "operators/cleaning.py", "operators/cdc.py", "plans/loads.py"
PROFILE, CONTRACTS, META = "operators/profile.py", "operators/contracts.py", "operators/metadata.py"
RECONCILE, TABLES, TEXT = "operators/reconcile.py", "sinks/tables.py", "functions/text.py"
TYPES, ERRORS, STREAMS = "functions/types.py", "functions/errors.py", "streaming/streams.py"
VERSIONED, FILES = "sinks/versioned.py", "sources/files.py"

# (query, file, right text, wrong text)
MUTATIONS = [
    ("clean_trim_cells", TEXT, '"\\t\\n\\x0b', '"\\n\\x0b'),
    ("clean_trim_headers", CLEANING, "c.strip(text.WHITESPACE) for c", "c.lstrip(text.WHITESPACE) for c"),
    ("clean_null_tokens_strict", TEXT, "short & F.lower(c).isin", "short & c.isin"),
    ("clean_null_tokens_basic", TEXT, "return c.isin(BASIC_NULLS)", "return F.lower(c).isin(BASIC_NULLS)"),
    ("clean_drop_empty", CLEANING, "reduce(Column.__and__, tests)", "reduce(Column.__or__, tests)"),
    ("clean_coerce_numeric", CLEANING, "ratio: float = 0.85) -> DataFrame", "ratio: float = 0.99) -> DataFrame"),
    ("clean_duplicates_removed", CLEANING, "expand_copies(count_copies(df), F.col(COPIES) - 1)", "expand_copies(count_copies(df), F.col(COPIES))"),
    ("clean_outliers", CLEANING, "F.stddev_pop(_as_number(df, c))", "F.max(_as_number(df, c))"),
    ("clean_strict", CLEANING, "self._filled.where(~self._far)", "self._filled"),
    ("clean_quarantine", CLEANING, "expand_copies(self._filled, copies - 1)", "expand_copies(self._filled, copies)"),
    ("clean_basic", CLEANING, 'CleanResult(df, "basic", ratio, None)', 'CleanResult(df, "strict", ratio, None)'),
    ("clean_report", CLEANING, "sum(copies - 1) filter", "sum(copies) filter"),
    ("classify_errors", ERRORS, "reversed(list(enumerate(ERROR_RULES, start=1)))", "list(enumerate(ERROR_RULES, start=1))"),
    ("full_load", LOADS, "c.upper() for c", "c.lower() for c"),
    ("incremental_extract", LOADS, "if inclusive else c > bound", "if inclusive else c >= bound"),
    ("upsert_load", TABLES, 'keys, "left_anti")', 'keys, "left_semi")'),
    ("next_watermark", LOADS, 'F.max(column(watermark)).alias', 'F.min(column(watermark)).alias'),
    ("coerce_for_target", LOADS, "c = F.to_json(c)", 'c = c.cast("string")'),
    ("cdc_window", CDC, 'place > given(from_lsn)', 'place >= given(from_lsn)'),
    ("cdc_latest", CDC, 'F.struct(*_places(feed), "op", *', 'F.struct("op", *_places(feed), *'),
    ("cdc_apply_partial", CELLS, 'F.col("op").isin(DELETE, INSERT), place', 'F.col("op").isin(DELETE), place'),
    ("cdc_merge_partial", CELLS, "later = pb.isNotNull() & (pa.isNull() | (pb >= pa))", "later = pb.isNotNull()"),
    ("cdc_positions", POSITIONS, 'F.lpad(F.split_part(plain, F.lit("/"), F.lit(i)), 8, "0")', 'F.split_part(plain, F.lit("/"), F.lit(i))'),
    ("cdc_apply", CDC, 'F.col("op") != DELETE', 'F.col("op") != INSERT'),
    ("cdc_counts", CDC, 'F.col("op") == AFTER).alias("updates")', 'F.col("op") >= AFTER - 1).alias("updates")'),
    ("cdc_apply_json", CDC, 'F.coalesce(change["columns"], change["identity"])', 'change["columns"]'),
    ("cdc_parse_json", CDC, "identity array<struct<name", "ident array<struct<name"),
    ("reconcile_sums", RECONCILE, "< {tolerance}D, false)", "< 1e9D, false)"),
    ("reconcile_verdict", RECONCILE, "c -> not c.sum_match", "c -> c.sum_match"),
    ("load_job_run", LOADS, '"status": "error", "error"', '"status": "success", "error"'),
    ("profile_text_columns", PROFILE, '"count_if({test}) as {k}{i}"', '"count({c}) as {k}{i}"'),
    ("quality_issues", PROFILE, "share >= 0.05", "share >= 0.15"),
    ("quality_score", PROFILE, "otherwise(copies - 1)", "otherwise(copies)"),
    ("watermark_candidates", PROFILE, "score += 5", "score += 3"),
    ("key_candidates", PROFILE, '"max(n) = 1 as is_key"', '"max(n) = 2 as is_key"'),
    ("key_lattice", PROFILE, "if not any(key < set(c) for key in keys)", "if True"),
    ("map_types", TYPES, "F.lit(0), F.least(F.coalesce(scale", "F.lit(1), F.least(F.coalesce(scale"),
    ("conform_cast", CONTRACTS, "try_cast(T.DecimalType(*size))", "try_cast(T.DecimalType(size[0], 0))"),
    ("conform_violations", CONTRACTS, "F.length(c) > limit if limit", "F.length(c) >= limit if limit"),
    ("contract_pk", CONTRACTS, '.where("__n > 1")', '.where("__n > 2")'),
    ("standard_names", TEXT, "F.upper(name)", "name"),
    ("schema_drift", META, '"full_outer"', '"left"'),
    ("lineage_closure", META, "known.append(newest)", "known[:] = [newest]"),
    ("run_summary", META, 'F.struct("started_at", "run_id", "status")', 'F.struct("status", "started_at", "run_id")'),
    ("query_history_stats", META, "(F.col(rank) <= upto)", "(F.col(rank) < upto)"),
    ("scan_delimited", FILES, "csv.Sniffer().sniff(head.decode(\"utf-8\", errors=\"replace\"), delimiters=candidates).delimiter", '","'),
    ("scan_json_records", FILES, "F.array_contains(present, k)), F.lit(0))", "F.array_contains(present, k)), F.lit(1))"),
    ("register_view", TEXT, '"[-. ]", "_"), r"[^a-z0-9_]"', '"[-.]", "_"), r"[^a-z0-9_]"'),
    ("stream_cdc", CDC, 'F.col("__applied") >= F.col(POSITION)', 'F.col("__applied").isNull()'),
    ("stream_incremental", VERSIONED, "dropped = set(buckets)", "dropped = set()"),
]


def main(sf_dir: str, only: list[str]) -> int:
    copy = Path(tempfile.mkdtemp(prefix="run-")) / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    survived = 0
    for name, file, right, wrong in MUTATIONS:
        if only and name not in only:
            continue
        path = copy / "ferrywell" / file
        original = path.read_text()
        if right not in original:
            print(f"STALE {name}: {right}", flush=True)
            survived += 1
            continue
        path.write_text(original.replace(right, wrong))
        run = subprocess.run(
            [sys.executable, "tests/compare.py", sf_dir, name], cwd=copy, capture_output=True, text=True, timeout=300
        )
        path.write_text(original)
        survived += run.returncode == 0
        print(f"{'SURVIVED' if run.returncode == 0 else 'caught'} {name}", flush=True)
    print(f"{survived} not caught")
    return survived


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
