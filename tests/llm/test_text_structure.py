"""Runs, collocations and main texts against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest

from ferrywell.llm import html_tree, html_wrapper, periodic_runs, phrase_graph

DOCS = "doc_id bigint, text string, lang string, n bigint, gram string, head string, words string, runs string"
PAGES = "page_id bigint, url string, html string, host string, h string, salt string, rank string, template string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x") for r in rows], DOCS)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], PAGES)


def plain_runs(words, rule):
    found = set()
    for q in range(1, len(words) // rule.times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            part = words[start:start + size]
            if i > start and size >= max(rule.least, rule.times * q) and not any(
                    part[r:] == part[:-r] for r in range(1, q)):
                found.add((start, size, q))
            i = max(i, start + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


@pytest.mark.parametrize("rule", [periodic_runs.Rule(), periodic_runs.Rule(3, 2), periodic_runs.Rule(2, 3), periodic_runs.Rule(10, 5)])
def test_runs_of_small_texts(rule):
    pick = random.Random(rule.times)
    for _ in range(1200):
        kinds = pick.choice([1, 2, 3, 5])
        words = [pick.randrange(kinds) for _ in range(pick.randrange(60))]
        unit = [pick.randrange(kinds + 1) for _ in range(pick.randrange(1, 8))]
        at = pick.randrange(len(words) + 1)
        words[at:at] = (unit * 9)[:pick.randrange(9 * len(unit))]
        assert periodic_runs.runs_of(np.array(words, np.int64), rule) == plain_runs(words, rule)


def test_segments_of_an_access_are_the_last_common_suffixes():
    pick = random.Random(5)
    text = [pick.randrange(3) for _ in range(120)]
    automaton = periodic_runs.SuffixAutomaton(text)
    ends = periodic_runs.LastEnds(automaton)

    def common(i, j):
        k = 0
        while k <= j and text[i - k] == text[j - k]:
            k += 1
        return k

    for i, state in enumerate(automaton.prefixes):
        wanted, longest = set(), 0
        for j in range(i - 1, -1, -1):
            if common(i, j) > longest:
                longest = common(i, j)
                wanted.add((j, longest))
        assert set(ends.access(state, i)) == wanted


def test_runs_by_the_contract(spark):
    pick = random.Random(2)
    rows = [(i, " ".join(str(pick.randrange(pick.choice([4, 90]))) for _ in range(pick.randrange(120))), "en") for i in range(500)]
    rows += [(None, "a " * 9, None), (None, None, None), (7, None, "x"), (8, " \n\t", None), (9, "a b " * 3000, None), (9, "a b " * 3000, None)]
    rows.append((1000, "  x x\x1c " * 8, None))

    def answer(doc_id, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words, periodic_runs.Rule())
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        return (doc_id, len(runs), s, m, q, 1000 * m // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(),
                hashlib.sha256(" ".join(kept).encode()).hexdigest())

    found = Counter(tuple(r) for r in periodic_runs.detect(docs(spark, rows)).collect())
    assert found == Counter(answer(i, t) for i, t, _ in rows)
    assert sum(n for row, n in found.items() if row[1]) > 20
    assert periodic_runs.detect(docs(spark, [])).isEmpty()
    left = {r["doc_id"]: r for r in periodic_runs.collapsed(docs(spark, [(1, "x a b a b a b a b y", "en")])).collect()}
    assert left[1]["text"] == "x a b y" and left[1]["runs"] == [[1, 8, 2]]


def plain_collocations(rows, least, share, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        count = counts.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            count.update(tuple(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = []
    for lang, count in counts.items():
        kept = {g: n for g, n in count.items() if len(g) > 1 and n >= least}
        ranked = []
        for gram, a in kept.items():
            if any(len(x) > len(gram) and 100 * f >= share * a and gram in (x[:2], x[1:]) for x, f in kept.items()):
                continue
            cuts = [(10**6 * a * a // (count[gram[:k]] * count[gram[k:]]), k) for k in range(1, len(gram))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(gram).encode(), count[gram[:k]], count[gram[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


@pytest.mark.parametrize("least, share, top", [(10, 50, 2000), (2, 80, 15)])
def test_collocations(spark, monkeypatch, least, share, top):
    monkeypatch.setattr(phrase_graph, "PLACES", 500)
    pick = random.Random(4)
    words = [*"the of and to a é Ünï".split(), *(f"w{i}" for i in range(30))]
    chains = ["one two three four five six seven", "red green blue"]

    def text():
        parts = [pick.choice(chains) if pick.random() < 0.1 else pick.choice(words) + pick.choice(["", "", "", ".", "\n", ",", "\t"])
                 for _ in range(pick.randrange(150))]
        return " ".join(parts)

    rows = [(i, text(), pick.choice(["en", "en", "de", None])) for i in range(120)]
    rows += [(None, None, None), (1, "", "fr"), (2, rows[0][1], "en"), (3, "Alone Here", "xx"), (4, ". ; !", "yy"), (5, "a " * 5000, "zz")]
    found = phrase_graph.collocations(docs(spark, rows), least, share, top).collect()
    assert sorted(tuple(r) for r in found) == plain_collocations(rows, least, share, top)
    assert phrase_graph.collocations(docs(spark, [])).isEmpty()


def test_unary_paths_are_compacted(spark):
    graph = phrase_graph.edges(docs(spark, [(i, "x p q r s t. p q r s t, q r u" if i % 2 else "y p q r s t", "en") for i in range(20)]))
    flows = phrase_graph.node_flows(graph)
    triples = graph.where("n >= 10 and gram like '% % %'")
    found = {(r["phrase"], r["n_words"], r["n"]) for r in phrase_graph.paths(phrase_graph.compacted(triples, flows)).collect()}
    assert found == {("p q r", 3, 30), ("q r s t", 4, 30), ("q r u", 3, 10), ("x p q", 3, 10), ("y p q", 3, 10)}


def article(html):
    inner = re.search("<article>(.*)</article>", html, re.S)[1].replace("<br>", " ")
    parts = (" ".join(unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split("</?(?:p|h1)>", inner))
    return "\n\n".join(filter(None, parts))


def test_articles_of_the_given_pages(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {r["page_id"]: article(r["html"]) for r in given.collect()}
    for bound in (html_wrapper.BROADCAST_BYTES, 0):
        found = html_wrapper.extract(given, bound).collect()
        assert {r["page_id"]: r["text"] for r in found} == wanted
        assert all(r["n_chars"] == len(r["text"]) for r in found)


def prose(pick, n):
    return " ".join(pick.choice("lorem ipsum dolor sit amet elit sed do".split()) + str(pick.randrange(99)) for _ in range(n))


def test_what_is_constant_on_a_host_is_template(spark):
    pick = random.Random(3)
    rows, wanted = [], {}
    for i in range(40):
        first, second = prose(pick, 40), prose(pick, 30)
        linked = "".join(f"<li><a href=/{prose(pick, 1)}>{prose(pick, 3)}</a>" for _ in range(4))
        html = (f"<div class=q1><div>Daily Bugle</div><ul>{linked}</ul></div><div class=z5><h1>Title {i}</h1><p>{first}"
                f"<div class=k8>Buy our paper for only one crown and read it every day of the week</div><p>{second}</p></div>"
                f"<div class=k9><p>{prose(pick, 5)}</div><div class=m2>All rights are ours</div>")
        rows.append((i, f"http://News.example.com:80/{i}", html))
        wanted[i] = f"Title {i}\n\n{first}\n\n{second}"
    copy = "<div class=z5><h1>Same</h1><p>" + prose(pick, 50) + "</div><div class=m2>All rights</div>"
    rows += [(100 + i, f"http://copies.example.com/{i}", copy + f"<ul><li><a href=/{i}>more {i}</a></ul>") for i in range(20)]
    found = {r["page_id"]: r["text"] for r in html_wrapper.extract(pages(spark, rows)).collect()}
    assert {i: found[i] for i in range(40)} == wanted
    assert all(found[100 + i].startswith("Same\n\n") and "more" not in found[100 + i] for i in range(20))


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>part {i}" for i in range(20_000))
    rows = [
        (1, None, None), (2, "", ""), (None, "no address", "<p>alone"), (3, "http://a/", "just &lt;text&gt; &amp; more"),
        (4, "http://a/", "<<p>a<b>c</b>d<br>e</p></p></div></td>f<!-- x"), (5, "http://a/", "<script>var x = '<p>no</p>'"),
        (6, "http://a/", long), (7, "http://a/", "<p>x"), (7, "http://a/", "<p>x"), (8, "http://a/", "<form><h1>T</h1><p>in a form</form>"),
        (9, "http://[::1]/%", "<p hidden>no<p title='a > b'>yes &nbsp; it\nis <span class=ad>not this</span>so"),
        (10, "http://b/", "<main><article><header><h1>H</h1></header><p>t<aside>no</aside></article><section class=comments><article class=comment>c</article></section></main>"),
    ]
    found = Counter((r["page_id"], r["text"]) for r in html_wrapper.extract(pages(spark, rows)).collect())
    assert found == Counter([
        (1, ""), (2, ""), (None, "alone"), (3, "just <text> & more"), (4, "<\n\nacd e\n\nf"), (5, ""),
        (6, "\n\n".join(f"part {i}" for i in range(20_000))), (7, "x"), (7, "x"), (8, "T\n\nin a form"), (9, "yes it is so"), (10, "H\n\nt")])
    assert html_wrapper.extract(pages(spark, [])).isEmpty()


def test_matching_keeps_the_order_and_finds_most_pairs():
    root = html_wrapper.outline([html_tree.parse("<div class=a></div><div class=b><ul></ul></div><div class=c></div>")])
    tree = html_tree.parse("<div class=c></div><div class=b><ul></ul></div><div class=d></div>")
    assert [slot.key for slot, _ in html_wrapper.aligned(root, tree)] == ["body", "div.b", "ul"]
    html_wrapper.extend(root, tree)
    assert [slot.key for slot in root.kids] == ["div.a", "div.c", "div.b", "div.c", "div.d"] or len(root.kids) == 5
    again = html_wrapper.from_json(html_wrapper.to_json(root))
    assert [s.key for s in again.below()] == [s.key for s in root.below()]
