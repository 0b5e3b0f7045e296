"""Operators against plain versions, and on rows that are odd in every way."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrywell.llm import (
    byte_bpe, jaccard_join, language_id, license_scan, line_dedup, packing, quality, sentencepiece_viterbi, suffix_dedup,
    token_rollup,
)
from ferrywell.llm.components import connected_components
from ferrywell.llm.exact_dedup import ExactDedup
from ferrywell.session import Folder, new_folder, shared_folder

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, words string, row string, key string, "
          "t string, spans string, s string, n bigint, d string, h string, ledger string, id string, maybe boolean")
WORDS = "the of and to in is it on as by or at an be he we so no up my".split()


def prose(seed, n, sep=" "):
    pick = random.Random(seed)
    return sep.join(pick.choice(WORDS) + str(pick.randrange(400)) for _ in range(n))


def frame(spark, pairs):
    """Documents with columns that have the operators' inner names."""
    rows = [(i, t, None if i is None else "en", None, None, *["x"] * 6, 1, *["x"] * 4, True) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


LONG = prose(1, 60_000)
ODD = [
    (None, None), (None, "no id"), (1, None), (2, ""), (3, " \n\t\n "), (4, LONG), (5, LONG), (6, "ünï ∆∆ 中文"), (7, "x"),
    (8, prose(2, 200)), (8, prose(2, 200)), (9, prose(2, 200)), (10, "a" * 3000), (11, "a " * 900), (-3, prose(3, 90)),
    (12, "One line here today.\n" * 3), (13, "Released under the MIT License."),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def answer(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


SETTING = jaccard_join.Setting(width=3, percent=90)


def model(spark):
    texts = [("en", "the house and the dog of the town " * 20), ("de", "das haus und der hund aus der stadt " * 20)]
    return language_id.fit(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id bigint, text string, lang string"))


BY_ROW = {
    "quality": lambda s, d: quality.ledger(d),
    "license": lambda s, d: license_scan.scan(d),
    "lines": lambda s, d: line_dedup.decisions(d),
    "jaccard": lambda s, d: jaccard_join.similar_documents(d, SETTING),
    "suffix": lambda s, d: suffix_dedup.measured(d),
    "language": lambda s, d: language_id.predict(d, model(s)),
    "pieces": lambda s, d: sentencepiece_viterbi.encode(d),
    "tokens": lambda s, d: token_rollup.count_tokens(d),
}
CLEANING = {
    "quality": quality.filtered, "lines": line_dedup.cleaned, "jaccard": jaccard_join.distinct_documents,
    "suffix": suffix_dedup.cleaned,
}


@pytest.mark.parametrize("name", BY_ROW)
def test_one_row_for_each_row(spark, odd, none, name):
    found = Counter(r["doc_id"] for r in BY_ROW[name](spark, odd).collect())
    assert found == Counter(i for i, _ in ODD)
    assert BY_ROW[name](spark, none).collect() == []


@pytest.mark.parametrize("name", CLEANING)
def test_stages_keep_the_columns(spark, odd, none, name):
    made = CLEANING[name](odd)
    assert made.columns == odd.columns and {r["doc_id"] for r in made.collect()} <= {i for i, _ in ODD}
    assert CLEANING[name](none).collect() == []


# -- exact duplicates -----------------------------------------------------------------------------


def plain_copies(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies_in_several_batches(spark, odd, weak):
    path = new_folder(spark, "copies")
    state = ExactDedup(spark, new_folder(spark, "state"), (lambda t: F.unhex(F.hex(F.length(t) % 3))) if weak else ExactDedup.__init__.__defaults__[0])
    for part in range(3):
        odd.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(path)
        state.ingest(path, files_per_batch=1)
    state.ingest(path)  # nothing new
    rows = state.decisions(path).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == plain_copies(ODD)
    groups = Counter(r.text_sha256 for r in rows)
    assert Counter(r.text_sha256 for r in rows if r.kept) == dict.fromkeys(groups, 1)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_no_documents_no_decisions(spark, none):
    path = new_folder(spark, "copies")
    none.write.parquet(path)
    state = ExactDedup(spark, new_folder(spark, "state"))
    state.ingest(path)
    assert state.decisions(path).collect() == []


# -- quality --------------------------------------------------------------------------------------


def test_measures(spark):
    text = "a b c d e f g h # a b c d e f g h\n\nx $$ y\nx $$ y\n"
    row = quality.ledger(frame(spark, [(1, text), (2, "It IT it it " * 10)])).orderBy("doc_id").collect()
    first, second = row
    assert (first.n_words, first.n_symbols, first.n_lines, first.n_dup_lines, first.n_repeat_words) == (23, 5, 3, 1, 16)
    assert second.n_stutter == 10 and second.n_capitals == 30 and second.failed & quality.BITS["stutter"]


def test_ablations_count_lone_rejections(spark):
    lines = spark.createDataFrame([(1,), (1,), (3,), (0,), (4,)], "failed bigint")
    policy = quality.Policy("t", ("few_words", "repeats"))
    found = {r.rule: (r.fails, r.alone, r.seen_with) for r in quality.ablations(lines, policy).collect()}
    assert found == {"few_words": (3, 2, 3), "repeats": (1, 0, 3)}


# -- lines ----------------------------------------------------------------------------------------


def plain_lines(pairs, percent=80):
    lines = [((i, k), frozenset(re.findall(r"[^\x20\x09-\x0D]+", line)))
             for i, t in pairs for k, line in enumerate((t or "").split("\n"))]
    lines = sorted((p, s) for p, s in lines if s)
    gone = defaultdict(list)
    for at, (place, words) in enumerate(lines):
        if any(100 * len(words & other) >= percent * len(words | other) for _, other in lines[:at]):
            gone[place[0]].append(place[1])
    return gone


def test_only_the_removed_places_stay_on_disk(spark):
    folder = Folder(spark, f"{shared_folder(spark)}/ferrywell")
    before = set(folder.names())
    found = line_dedup.removed_lines(frame(spark, [(1, "a b c\nd e f"), (2, "c b a"), (3, None)]).select("doc_id", "text"))
    assert [n.rsplit("-", 1)[0] for n in set(folder.names()) - before] == ["line-removed"]
    assert [(r.d, r.removed) for r in found.collect()] == [(2, [0])]


def test_long_lines_without_words_in_common_are_no_candidates(spark):
    pick = random.Random(5)
    pairs = [(i, " ".join(f"{pick.randrange(10 ** 9)}x{i}" for _ in range(160))) for i in range(40)]
    pairs += [(100 + i, " ".join(t.split()[:-17] + [f"new{i}y{k}" for k in range(17)])) for i, t in pairs[:5]]
    docs = frame(spark, pairs).select("doc_id", "text")
    sets = line_dedup._sets(line_dedup._measured(docs, line_dedup._frequency_table(docs), 80))
    rows = sets.select("d", "n", "b1", "b2").persist()
    both = rows.alias("x").join(rows.alias("y"), (F.col("x.d") > F.col("y.d")) & line_dedup._possible("x", "y", 80))
    found = {(r[0], r[1]) for r in both.select("x.d", "y.d").collect()}
    assert found >= {(100 + i, i) for i in range(5)} and len(found) <= 10
    rows.unpersist()


def line_pairs(seed=5, n=60):
    pick = random.Random(seed)
    pairs = []
    for i in range(n):
        base = [prose(pick.randrange(12), 1 + pick.randrange(14)).split() for _ in range(4)]
        for words in base:
            if pick.random() < 0.5:
                words[pick.randrange(len(words))] = "new" + str(pick.randrange(9))
        pairs.append((i, "\n".join(" ".join(w) for w in base)))
    return pairs


def test_words_with_one_number_lose_no_match(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PLACES", 3)
    monkeypatch.setattr(line_dedup, "BUCKETS", 4)
    pairs = line_pairs()
    gone = plain_lines(pairs)
    found = answer(line_dedup.decisions(frame(spark, pairs)), "removed", "n_removed")
    assert {i: r for i, (r, _) in found.items()} == {i: gone.get(i, []) for i, _ in pairs}


def test_both_sides_of_the_line_join_read_one_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(1, 5, 0, 0, [7, 8]), (-2, 5, 0, 0, [7, 9]), (3, 5, 0, 0, [7, 8])]  # the second set is matched already
    marked = spark.createDataFrame(rows, "code bigint, n int, b1 bigint, b2 bigint, prefix array<int>")
    found = line_dedup._candidates(marked.select("code", "n", "b1", "b2", F.posexplode("prefix").alias("place", "word")), 80)
    assert {(r.x, r.y) for r in found.collect()} == {(2, 0), (2, 1)}
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("block", [1 << 12, 2])
def test_lines_like_earlier_ones(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    pick = random.Random(5)
    pairs = []
    for i in range(60):
        base = [prose(pick.randrange(12), 1 + pick.randrange(14)).split() for _ in range(4)]
        for words in base:
            if pick.random() < 0.5:
                words[pick.randrange(len(words))] = "new" + str(pick.randrange(9))
        pairs.append((i, "\n".join(" ".join(w) for w in base)))
    gone = plain_lines(pairs)
    found = answer(line_dedup.decisions(frame(spark, pairs)), "removed", "n_removed")
    assert {i: r for i, (r, _) in found.items()} == {i: gone.get(i, []) for i, _ in pairs}
    kept = answer(line_dedup.cleaned(frame(spark, pairs)), "text")
    for i, text in pairs:
        rest = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone.get(i, []))
        assert kept.get(i, ("",)) == (rest,)


# -- n-gram join ----------------------------------------------------------------------------------


def plain_components(pairs, width, percent):
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_copies(spark, width=5, percent=80, block=2):
    pick = random.Random(width)
    pairs = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "one two"), (5, "ONE two")]
    for i in range(6, 110):
        words = prose(pick.randrange(10), pick.choice([4, 9, 12, 13, 30, 31, 120])).split()
        for _ in range(pick.randrange(4)):
            words[pick.randrange(len(words))] = f"edit{pick.randrange(50)}"
        pairs.append((i, (" " if pick.random() < 0.8 else "\n").join(words).title() if pick.random() < 0.3 else " ".join(words)))
    setting = jaccard_join.Setting(width=width, percent=percent, block=block)
    found = answer(jaccard_join.similar_documents(frame(spark, pairs), setting), "n_shingles", "component_id")
    assert found == plain_components(pairs, width, percent)


def test_near_copies_are_judged_by_their_own_text(spark):
    a, b, c, d, e = (prose(40 + i, 200) for i in range(5))
    rows = [(None, a), (None, b), (5, c), (None, c + " more"), (None, d), (7, e), (7, prose(50, 90)), (3, e + " more"),
            (-1, prose(51, 90)), (None, prose(52, 90)), (None, prose(52, 90)), (-1, prose(53, 90)), (8, d + " more"),
            (9, prose(54, 90)), (9, prose(54, 90)), (6, prose(54, 90) + " x"), (None, None), (None, ""), (4, None), (4, None)]
    groups = plain_components([(at, t) for at, (_, t) in enumerate(rows)], 5, 80)
    expected, best = [], {}
    for at, (i, t) in enumerate(rows):
        size, group = groups[at]
        if not size:
            expected.append((i, t))
        elif group not in best or (i is None, i or 0, t) < best[group][0]:
            best[group] = ((i is None, i or 0, t), (i, t))
    found = jaccard_join.distinct_documents(frame(spark, rows)).select("doc_id", "text").collect()
    assert Counter(map(tuple, found)) == Counter(expected + [row for _, row in best.values()])


def test_enumerated_sets_meet_posted_ones(spark, monkeypatch):
    pairs = [(i, prose(7, n)) for i, n in enumerate(range(3, 40))] + [(50 + i, prose(7, n) + " more") for i, n in enumerate(range(3, 40))]
    monkeypatch.setattr(jaccard_join, "_boundary", lambda sets, setting: 20)
    found = answer(jaccard_join.similar_documents(frame(spark, pairs), SETTING), "n_shingles", "component_id")
    assert found == plain_components(pairs, 3, 90)


def test_components(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.component for r in found.collect()} == {n: top(n) for e in edges if e[0] != e[1] for n in e}


# -- long repeats ---------------------------------------------------------------------------------


def plain_repeats(pairs):
    seen = Counter(raw[i:i + 400] for _, t in pairs for raw in [(t or "").encode()] for i in range(len(raw) - 399))
    found = []
    for doc, t in pairs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 399):
            if seen[raw[i:i + 400]] > 1:
                gone[i:i + 400] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + (len(raw) > 0 and gone[0]))
        found.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(found)


def repeating():
    shared, other = prose(20, 200), prose(21, 90)
    pairs = [(i, prose(30 + i, 30 + i) + shared[i * 7:i * 7 + 399 + i % 3] + "é" * (i % 2) + prose(90 + i, 25)) for i in range(12)]
    pairs += [(20, other), (21, other), (22, other + "!"), (23, "ab" * 700), (24, "z" * 401), (25, "z" * 400), (26, None), (27, "short")]
    pairs += [(28, shared + " and " + shared), (29, prose(29, 40) + "ab" * 300)]
    return pairs


@pytest.mark.parametrize("block", [4096, 1])
def test_repeats_are_exact(spark, block):
    pairs = repeating()
    found = suffix_dedup.measured(frame(spark, pairs), suffix_dedup.Setting(block=block))
    assert Counter(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == plain_repeats(pairs)


def test_contexts_of_a_common_line_are_left_out_before_their_strings_are_dealt(spark):
    """Nearly all contexts of a very frequent key share just the line that holds it."""
    line, passage = prose(22, 30), prose(23, 150)
    texts = [prose(200 + i, 90) + line + prose(300 + i, 90) for i in range(40)]
    texts += [prose(400 + i, 90) + line + passage + prose(500 + i, 90) for i in range(2)]
    rows = []
    for text in texts:
        raw = text.encode()
        found = suffix_dedup.anchors(np.frombuffer(raw, np.uint8))
        for key, context, pos, before, after in zip(found.key, found.context, found.pos, found.before, found.after, strict=True):
            rows.append((int(key), int(context), int(before), bytearray(raw[pos - before:pos + after])))
    hot = spark.createDataFrame(rows, suffix_dedup.CONTEXT).repartition(3)
    left = {r.context for r in suffix_dedup._groups(hot).collect()}
    assert 1 <= len(left) < len(rows) / 5
    assert {r.context for r in suffix_dedup._dealt(hot).collect()} <= left


def test_contexts_with_all_strings_of_a_group_in_common_are_compared_once(spark):
    """Sixty texts hold one passage: few groups of its contexts are left to compare string by string."""
    passage = prose(24, 120)
    rows, texts = [], [prose(600 + i, 60) + passage + prose(700 + i, 60) for i in range(60)]
    for text in texts:
        raw = text.encode()
        found = suffix_dedup.anchors(np.frombuffer(raw, np.uint8))
        for key, context, pos, before, after in zip(found.key, found.context, found.pos, found.before, found.after, strict=True):
            rows.append((int(key), int(context), int(before), bytearray(raw[pos - before:pos + after])))
    hot = spark.createDataFrame(rows, suffix_dedup.CONTEXT).repartition(3)
    groups = suffix_dedup._groups(hot).collect()
    assert len(groups) >= 60 and sum(r.least <= r.most for r in groups) >= 60
    assert sum(r.groups.bit_count() for r in groups) < 3 * len(groups)
    found = suffix_dedup.measured(frame(spark, list(enumerate(texts))), suffix_dedup.Setting(block=1))
    assert Counter(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == plain_repeats(
        list(enumerate(texts)))


def test_long_texts_are_indexed_in_stretches(spark, monkeypatch):
    raw = np.frombuffer(prose(8, 9000).encode(), np.uint8)
    whole = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    parts = suffix_dedup.anchors(raw)
    assert all((getattr(whole, c) == getattr(parts, c)).all() for c in ("pos", "key", "context", "before", "after"))
    assert max(np.diff(whole.pos)) <= suffix_dedup.SPAN


def test_levels_merge_like_a_counter(spark):
    index = suffix_dedup.SuffixIndex(spark, new_folder(spark, "index"))
    for batch in range(5):
        index.add(spark.createDataFrame([(batch % 2, batch, f"t{batch}", 0, 0, 400), (100 + batch, 1, "u", 0, 0, 400)], suffix_dedup.ENTRY))
    assert sorted(index.levels().values()) == [0, 2]
    assert Counter(r.key for r in index.repeated().collect()) == {0: 3, 1: 2}


def test_cut_characters_go_whole(spark):
    text = "é" * 300
    made = suffix_dedup.cleaned(frame(spark, [(1, "é" + text + "xy"), (2, "z" + text), (3, None)]))
    assert answer(made, "text")[1] == ("xy",) and answer(made, "text")[3] == (None,)


def test_wrapped_license_notices(spark):
    bsd = license_scan.TEMPLATES[5][1].split()
    pairs = [(n, "Some file.\n" + "\n".join(" # " + " ".join(bsd[i::1][:len(bsd) // n + 1]) for i in range(0, len(bsd), len(bsd) // n + 1)) + "\nMore.")
             for n in (1, 2, 3, 4)]
    pairs += [(9, "\n".join(bsd)), (10, "\n\n".join([" ".join(bsd[:7]), "other words here", " ".join(bsd[7:])]))]
    found = answer(license_scan.scan(frame(spark, pairs)), "labels", "score")
    assert all(found[n] == ("bsd", 1.0) for n in (1, 2, 3, 4))
    assert found[9] == ("", 0.0) and found[10] == ("", 0.0)  # over more lines than a block has


# -- languages ------------------------------------------------------------------------------------


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.fold(F.col("doc_id")) == 1
    found = language_id.predict(docs.where(held).select("doc_id", "text"), language_id.fit(docs.where(~held)))
    right = found.join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_undetermined_and_narrow(spark):
    found = answer(language_id.predict(frame(spark, [(1, None), (2, "12 !!"), (3, "the dog of the town and the house"), (4, "q")]), model(spark)),
                   "lang_pred", "rejected")
    assert found == {1: ("und", True), 2: ("und", True), 3: ("en", False), 4: ("de", True)}


# -- token counts ---------------------------------------------------------------------------------


def test_every_chosen_row_has_its_share_of_the_dictionary(spark):
    """Letters of two bytes take no more room than others."""
    rows = [(i, lang, " ".join(f"{word}{i}" for _ in range(80))) for i, (lang, word) in enumerate([("en", "word"), ("ru", "слово")] * 60)]
    fitted = dict(language_id.fit(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), 40, 4000).dictionaries)
    for lang in ("en", "ru"):
        parts = fitted[lang].split(b"\n")
        assert len(parts) == 40 and len(fitted[lang]) <= 4000
        assert all(97 <= len(part) <= 99 and part.decode() for part in parts)


def test_languages_equal_plain_compression(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(100)
    fitted = language_id.fit(docs.where("doc_id % 2 = 0"), 20, 8000)

    def size(text, content):
        raw, size = text.lower().encode(), 0
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        for at in range(0, len(raw), fitted.chunk):
            compressor = zstandard.ZstdCompressor(fitted.level, dict_data=made, write_content_size=False, write_dict_id=False)
            size += len(compressor.compress(raw[at:at + fitted.chunk]))
        return size

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = answer(language_id.predict(docs, fitted), "lang_pred", "score")
    assert len(found) == len(texts) == 100
    for doc_id, text in texts.items():
        if not text or not any(map(str.isalpha, text)):
            assert found[doc_id] == ("und", 0.0)
            continue
        (least, lang), (second, _) = sorted((size(text, content), lang) for lang, content in fitted.dictionaries)[:2]
        assert found[doc_id] == (lang, pytest.approx(min(1.0, 0.5 + 5 * (second - least) / second)))


def test_totals_equal_a_plain_sum(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from ferrywell.llm import queries

    small = "/root/testdata/sf0.001"
    tokenizer, wanted = Tokenizer.from_file(path("byte_bpe_50k.json")), Counter()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        wanted[r["source"], r["lang"], "byte_bpe_50k", "n"] += n
        wanted[r["source"], r["lang"], "byte_bpe_50k", "docs"] += 1
    found = Counter()
    for r in queries.QUERIES["op6_token_counts"](spark, small).collect():
        found[r["source"], r["lang"], r["tokenizer"], "n"] += r["n_tokens"]
        found[r["source"], r["lang"], r["tokenizer"], "docs"] += r["n_docs"]
    assert found == wanted


def test_rollup_adds_signed_batches_once(spark):
    def counts(rows):
        return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")

    old = counts([(1, "a", "en", "v1", 5), (2, "a", None, "v1", 7), (3, "b", "en", "v1", 1)])
    new = counts([(1, "a", "en", "v2", 6), (2, "a", None, "v1", 7), (3, "b", "en", "v1", 4)])
    rollup = token_rollup.TokenRollup(spark, new_folder(spark, "rollup"))
    assert rollup.totals().collect() == []
    assert rollup.commit("one", token_rollup.inserts(old)) and not rollup.commit("one", token_rollup.inserts(old))
    assert rollup.commit("two", token_rollup.revisions(old, new))
    rollup.merge()
    assert not rollup.commit("two", token_rollup.revisions(old, new))
    assert rollup.commit("three", token_rollup.deletes(new.where("doc_id = 3")))
    found = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert found == {("a", "en", "v2"): (1, 6), ("a", None, "v1"): (1, 7)}


# -- tokens, pieces, packing ----------------------------------------------------------------------

STRANGE = ["", " ", "a  b\n\n c\t\td  \n", "　a b \x85c\x1cd e\x1f f", "it's I'll 12ab  ", "<|endoftext|> x", "\n \n\n a", "é ​q 中文🙂",
           "a▁b <0x41> <s>", " " * 40 + "x" + " " * 17, "x" * 3000]


def texts():
    pick = random.Random(9)
    return STRANGE + ["".join(pick.choice("  abcdeinrst\n.,éß🙂中'") for _ in range(pick.randrange(1, 80))) for _ in range(400)]


def test_ids_are_those_of_the_libraries(monkeypatch):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    monkeypatch.setattr(byte_bpe, "SEGMENT", 50)
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    mine = byte_bpe.ByteBpe(byte_bpe.default_path())
    for text in texts():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == ids and mine.count(text) == len(ids)
    pieces = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.default_path())
    vocabulary = sentencepiece_viterbi.Vocabulary.from_file(sentencepiece_viterbi.default_path())
    for text, ids in zip(texts(), vocabulary.encode(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == pieces.encode(text)
        assert vocabulary.decode(ids) == text.replace("▁", " ")


def test_sentence_ends_without_pieces_looked_up(monkeypatch):
    """The ends are those of the pieces, though no piece is looked up or remembered."""
    monkeypatch.setattr(byte_bpe, "SEGMENT", 50)
    for mine in (byte_bpe.ByteBpe(byte_bpe.default_path()), byte_bpe.ByteBpe(byte_bpe.default_path(), markers=True)):
        for text in [*texts(), "One. Two!\n\nThree?\n \nFour。 5.6 x.\n", "a.\n", ".\n\n\n.", "é。\x85b <|endoftext|>\n.<|endoftext|>. x"]:
            ids, ends = mine.ids_and_sentences(text)
            assert not mine._known
            wanted, before = [], 0
            for pieces, found in mine._pieces(text):
                for piece, raw in zip(pieces, found, strict=True):
                    before += len(raw) // 4
                    if piece[-1] in ".!?\n。" and raw not in mine._marker_ids.values():
                        wanted.append(before)
            assert ends.tolist() == wanted and ids == mine.ids(text)
            mine._known.clear()


def test_few_lengths_of_pieces_are_tried(monkeypatch):
    """Lengths are told by three characters; words with common beginnings, unknown ones and forgotten pairs come out the same."""
    import sentencepiece

    path = sentencepiece_viterbi.default_path()
    vocabulary = sentencepiece_viterbi.Vocabulary.from_file(path)
    assert len(vocabulary._lengths) > len({piece[-2:] for piece in vocabulary._merges})
    monkeypatch.setattr(sentencepiece_viterbi, "REMEMBERED", 3)
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    words = [w[:k] for w in ("internationalisation", "interoperability", "ünïcödes", "中文字符", "aaaaaaaa", "🙂🙂a") for k in range(1, len(w) + 1)]
    for word, ids in zip(words, vocabulary.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == pieces.encode(word)


def test_markers_have_their_own_ids(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(byte_bpe, "SEGMENT", 50)
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine, mark = byte_bpe.ByteBpe(byte_bpe.default_path(), markers=True), "<|endoftext|>"
    marked = [f"a{mark}b", mark, f"{mark}{mark} x", f"one. {mark}\n two  {mark}  ", f"<|endoftext{mark}|>", "<|ENDOFTEXT|>"]
    marked += [t[:k] + mark + t[k:] for k, t in enumerate(texts())]
    for text in marked + texts():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == ids and mine.count(text) == len(ids)
        assert mine.ids_and_sentences(text)[0] == mine.ids(text)
    assert theirs.encode(marked[0], add_special_tokens=False).ids == [64, 50256, 65]
    docs = frame(spark, [(1, marked[0])])
    assert token_rollup.count_tokens(docs).first().n_tokens == 3
    assert np.frombuffer(packing.pack(docs).first().ids, "<u4").tolist() == [64, 50256, 65, 1]


def test_unigram_segmentation_is_the_best(spark):
    pick = random.Random(4)
    scores = {c: -5.0 for c in "▁abc"} | {"".join(pick.choices("abc", k=n)): -pick.random() * 8 for n in (2, 2, 3, 3, 4) for _ in range(4)}
    vocabulary = sentencepiece_viterbi.Vocabulary(scores, {p: i for i, p in enumerate(scores)}, {b: 1000 + b for b in range(256)}, "unigram")

    def best(word):
        return max((sum(scores[p] for p in cut) for cut in cuts(word)), default=0.0)

    def cuts(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            if word[:n] in scores:
                yield from ([word[:n], *rest] for rest in cuts(word[n:]))

    words = {"▁" + "".join(pick.choices("abc", k=pick.randrange(1, 9))) for _ in range(60)}
    for word, pieces in vocabulary.segment(words):
        assert "".join(pieces) == word and abs(sum(scores[p] for p in pieces) - best(word)) < 1e-9


def test_decoding_gives_the_texts(spark, odd):
    back = answer(sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(odd.where("doc_id != 8"))), "text")
    assert back[4] == (LONG,) and back[1] == ("",) and back[6] == ("ünï ∆∆ 中文",)


def test_cuts_cost_the_least():
    costs = packing.Costs(window=64, sentence=3, inside=9, each=2, least_power=8)
    pick = random.Random(2)
    for _ in range(30):
        places = np.array([0, *np.cumsum([pick.randrange(1, 30) for _ in range(25)])])
        penalties = np.array([pick.choice([0, 3, 9]) for _ in places])
        best = [0]
        for j in range(1, len(places)):
            def cost(i, j=j):
                n = places[j] - places[i]
                free = n in (8, 16, 32, 64)
                return best[i] + (0 if free else 64 - n) + 2 + penalties[j]
            best.append(min(cost(i) for i in range(j) if places[j] - places[i] <= 64))
        cuts = packing.choose_cuts(places, penalties, costs, last=False)
        total, i = 0, 0
        for j in cuts:
            n = places[j] - places[i]
            total += (0 if n in (8, 16, 32, 64) else 64 - n) + 2 + penalties[j]
            i = j
        assert total == best[-1] and cuts[-1] == len(places) - 1


@pytest.mark.parametrize("block", [1 << 20, 5000])
def test_packing_places_each_id_once(spark, odd, monkeypatch, block):
    monkeypatch.setattr(packing.Packer, "block", block)
    rows = packing.pack(odd.repartition(2, "doc_id")).collect()
    expected = Counter((i, byte_bpe.load(byte_bpe.default_path()).ids(t or "") + b"\1\0\0\0") for i, t in ODD)
    pieces = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.sequence_id].append(r)
    whole = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            text, left = r.ids, r.doc_tokens - r.length
        else:
            text, left = text + r.ids, left - r.length
        if not left:
            whole[(r.doc_id, bytes(text))] += 1
    assert whole == expected
    for sequence in pieces.values():
        offsets = sorted((r.offset, r.length) for r in sequence)
        assert [o for o, _ in offsets] == [sum(n for _, n in offsets[:k]) for k in range(len(offsets))]
        assert sum(n for _, n in offsets) <= 2048


def test_no_documents_no_pieces(spark, none):
    assert packing.pack(none).collect() == []
    assert isinstance(packing._batch([(1,) * 7], [pa.int64()] * 7, list("abcdefg")), pa.RecordBatch)


# -- licenses -------------------------------------------------------------------------------------


def test_licenses(spark):
    pairs = [(1, "Code. MIT\nLicense here, mit license."), (2, "licensed under CC BY NC 4.0"), (3, "THIS work is licensed under the GNU general public; License version 3"),
             (4, "the license of the work"), (5, "Redistribution, and use in source and binary forms with or without changes are permitted")]
    found = answer(license_scan.scan(frame(spark, pairs)), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert found[1] == (6, 2, 1, 4, "mit", "mit")
    assert found[2][1:] == (0, None, None, "", "cc-by-nc")
    assert found[3][1:] == (1, 7, 7, "gpl", "gpl")
    assert found[4][1:] == (0, None, None, "", "") and found[5][5] == "bsd"
