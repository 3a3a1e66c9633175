import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.llm import bm25_packing as pk
from quernel.llm import cap_filters as cf
from quernel.llm import html_text as ht
from quernel.llm import kdtree_topk as kt
from quernel.llm import license_scan as ls
from quernel.llm import line_dedup as ld
from quernel.llm import ordinal_quality as oq
from quernel.llm import queries as q
from quernel.llm import simhash_trie as sh
from quernel.llm import source_mixing as sm
from quernel.llm import substring_dedup as sd
from quernel.llm import word_hash as wh
from quernel.llm.common import components, numbered, unite
from tests.differ import assert_same, connection

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def odd_rows():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]

    def text(n, lines=1):
        return "\n".join(" ".join(rng.choice(words, n)) for _ in range(lines))

    a, b, passage = text(30, 5), text(90), text(60)
    rows = [(1, a, "x"), (2, a, "x"), (3, a, None), (4, b, "y"), (5, b.replace(" ", "  \t"), "y"), (6, text(80) + " " + passage, "x"), (7, passage + " " + text(70), "z")]
    rows += [(8, "", "x"), (9, None, "x"), (10, " \n\t ", "z"), (11, "one", "y"), (12, " ".join(["same"] * 200), "y"), (None, b, "y"), (None, None, None), (13, text(4000, 3), "x"), (13, text(20), "x"), (14, b, "y"), (14, b, "y")]
    rows += [(20 + k, text(int(rng.integers(1, 120)), int(rng.integers(1, 6))), ["x", "y", "z"][k % 3]) for k in range(40)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [(1, "a", "b")]).limit(0)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(name, spark, sf):
    assert_same(q.queries()[name](spark, sf), q.oracle_sql()[name], connection(sf))


# --- shared pieces


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, few):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, 1000 + k) for k in range(1, 200)] + [(k, k + 1) for k in range(2000, 2060)]
    label = np.arange(3000)
    unite(label, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: int(label[x]) for x in linked}


def test_components_of_nothing(spark):
    for few in (-1, 0, 10):
        assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_numbered_sums(spark):
    df = spark.createDataFrame([(k, (k * 7919) % 101, k % 4) for k in range(300)], "id long, o long, w long")
    rows = numbered(df, [F.col("o"), F.col("id")], "before", F.col("w")).collect()
    total = 0
    for r in sorted(rows, key=lambda r: (r["o"], r["id"])):
        assert r["before"] == total
        total += r["w"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x1cé ", max_size=40), max_size=6))
def test_word_hashes_part_texts_as_bytes_split_does(texts):
    import pyarrow as pa

    for first, end, data, offsets in wh.slices(pa.array(texts, pa.string()), 16):
        h, at = wh.word_hashes(data, offsets)
        words = [t.encode().split() for t in texts[first:end]]
        assert np.diff(at).tolist() == [len(w) for w in words]
        flat = [w for part in words for w in part]
        assert len({(a, b) for a, b in zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


def test_word_hashes_across_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    text = " ".join("x" * int(k) for k in rng.integers(1, 90, 300))
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = wh.word_hashes(raw, np.array([0, len(raw)]))[0]
    monkeypatch.setattr(wh, "PIECE", 64)
    assert (wh.word_hashes(raw, np.array([0, len(raw)]))[0] == whole).all()


# --- op1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_links(rows, least=0.93):
    n, label = [0] * len(rows), np.arange(len(rows))

    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n[i] += 1
                    unite(label, np.array([i]), np.array([j]))
    ids = [r[0] for r in rows]
    out = []
    for i, r in enumerate(rows):
        own = [ids[j] for j in range(len(rows)) if label[j] == label[i] and ids[j] is not None]
        c = min(own) if own else None
        out.append((r[0], n[i], c, r[0] is not None and r[0] == c))
    return sorted(out, key=str)


def test_cap_filters_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(k, (base[k % 12] + rng.normal(size=16) * 0.15).astype(np.float32).tolist(), int(k % 3 == 0)) for k in range(120)]
    v = rows[0][1]
    rows += [(500 + k, v, 1) for k in range(5)] + [(600, v, None), (601, None, 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, [float("inf")] + [1.0] * 15, 1), (605, [None] + [1.0] * 15, 1), (606, v[:8], 1), (None, v, 1), (0, v, 1), (607, [], 1), (608, [x * 1e30 for x in v], 1)]
    got = sorted((tuple(r) for r in cf.near_vectors(vectors(spark, rows), passes=60.0).collect()), key=str)
    assert got == brute_links(rows)


def test_cap_filters_chunks_of_a_hot_filter(spark):
    rng = np.random.default_rng(6)
    center = rng.normal(size=32)
    rows = [(k, (center + rng.normal(size=32) * 0.08).astype(np.float32).tolist(), 1) for k in range(150)]
    got = sorted((tuple(r) for r in cf.near_vectors(vectors(spark, rows), chunk=20, passes=40.0).collect()), key=str)
    assert got == brute_links(rows)


def test_cap_filters_empty(spark):
    assert cf.near_vectors(vectors(spark, [(1, [1.0], 1)]).limit(0)).count() == 0


def test_cap_filter_recall(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = sum(x[1] for x in brute_links(rows))
    got = q.queries()["op1_cap_filters"](spark, sf).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= got <= want


def test_list_decoding_is_complete():
    rng = np.random.default_rng(1)
    code = cf.ProductCode(24, 900, 8.0)
    x = cf._units(rng.normal(size=(40, 24)))
    row, word = code.decode(x)
    parts, at = [], 0
    for d, c in zip(code.cuts, code.codes, strict=True):
        parts.append((x @ code.turn)[:, at : at + d] @ c.T)
        at += d
    total = parts[0]
    for s in parts[1:]:
        total = (total[:, :, None] + s[:, None, :]).reshape(len(x), -1)
    r, w = np.nonzero(total >= code.height)
    assert set(zip(row.tolist(), word.tolist(), strict=True)) == set(zip(r.tolist(), w.tolist(), strict=True))


# --- op2


def test_license_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    filler = "completely unrelated prose about gardens and rivers " * 6
    rows = [("a/LICENSE", mit), ("a/b/x.txt", filler), ("a/b/c/y.txt", filler + "\n" + gpl), ("a/b/c/z.txt", None), ("q/z.txt", ""), ("top.txt", filler), (None, mit), ("a/b/x.txt", filler), ("a/b/d/COPYING", gpl), ("a/b/d/e/f.txt", filler)]
    df = spark.createDataFrame([(p, t, 1, "k") for p, t in rows], "path string, text string, license int, origin string")
    out = {r["path"]: r for r in ls.scan(df).collect()}
    assert ls.scan(df).count() == len(rows)
    assert out["a/b/x.txt"]["_license"] == "MIT" and out["a/b/x.txt"]["_origin"] == "inherited" and out["a/b/x.txt"]["found_in"] == "a/LICENSE"
    assert out["a/b/c/y.txt"]["_license"] == "GPL-3.0" and out["a/b/c/y.txt"]["_origin"] == "notice"
    assert out["a/b/c/z.txt"]["_license"] == "MIT" and out["a/b/d/e/f.txt"]["_license"] == "GPL-3.0"
    assert out["q/z.txt"]["_license"] is None and out["top.txt"]["_origin"] is None
    assert out[None]["_origin"] == "notice" and out["a/LICENSE"]["license"] == 1
    assert ls.scan(df.limit(0)).count() == 0


def _wrapped(text, prefix="", width=60):
    import textwrap

    return "\n".join(prefix + x for x in textwrap.wrap(text, width))


def _real_files():
    """Licence files as they are shipped, and sources with headers wrapped in comments."""
    t = ls.TEMPLATES
    mit = "MIT License\n\nCopyright (c) 2021 Jane Q. Public <jane@example.org>\n\n" + _wrapped(t["MIT"][3])
    bsd = "Copyright 2019 The Widget Authors\nAll rights reserved.\n\n" + _wrapped(t["BSD-3-Clause"][3], width=72)
    apache = "   " + "\n   ".join(["Apache License", "Version 2.0, January 2004", "http://www.apache.org/licenses/", "", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "", "1. Definitions."])
    apache += "\n" + _wrapped('"Licensor" shall mean the owner or entity authorized by that owner that is granting the rights described herein. ' * 40)
    gpl = "/* widget.c\n" + _wrapped(t["GPL-3.0"][1], " * ", 68) + "\n */\n" + "int main(void) { return frobnicate(7); }\n" * 80
    code = "def area(w, h):\n    return w * h\n" * 30
    return {"mit/LICENSE": mit, "mit/src/a.py": code, "bsd/LICENSE.txt": bsd, "bsd/src/deep/b.py": code, "apache/LICENSE": apache, "apache/c.py": code, "gpl/widget.c": gpl, "gpl/d.py": code, "gpl/COPYING": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + _wrapped("Everyone is permitted to copy and distribute verbatim copies of this license document. " * 60), "top/notes.md": "mit lizenz words of gardens\n" * 9}


def test_license_scan_of_whole_licence_files_and_wrapped_headers(spark):
    df = spark.createDataFrame(list(_real_files().items()), "path string, text string")
    out = {r["path"]: (r["license"], r["origin"], r["found_in"]) for r in ls.scan(df).collect()}
    assert out["mit/LICENSE"] == ("MIT", "notice", "mit/LICENSE") and out["mit/src/a.py"] == ("MIT", "inherited", "mit/LICENSE")
    assert out["bsd/LICENSE.txt"][:2] == ("BSD-3-Clause", "notice") and out["bsd/src/deep/b.py"] == ("BSD-3-Clause", "inherited", "bsd/LICENSE.txt")
    assert out["apache/LICENSE"][:2] == ("Apache-2.0", "notice") and out["apache/c.py"] == ("Apache-2.0", "inherited", "apache/LICENSE")
    assert out["gpl/widget.c"][:2] == ("GPL-3.0", "notice") and out["gpl/d.py"] == ("GPL-3.0", "inherited", "gpl/COPYING")
    assert out["top/notes.md"] == (None, None, None)


def _brute_notice(files):
    """Best (licence, cosine) of each file over all runs of lines, plainly in Python."""
    import math

    rows, n = ls.template_rows(), len(files)
    terms = [ls._terms(t or "") for _, t in files]
    idf = {t: math.log((n + 1) / (sum(t in x for x in terms) + 1)) + 1 for _, _, t, _ in rows}
    caps = ls.line_caps()
    flat = [(name, ls._terms(text)) for name in sorted(ls.TEMPLATES) for text in ls.TEMPLATES[name]]

    def cosine(a, b):
        w = lambda x: {t: k * idf.get(t, math.log(n + 1) + 1) for t, k in x.items()}
        a, b = w(a), w(b)
        return round(sum(v * b.get(t, 0) for t, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 6)

    out = {}
    for path, text in files:
        lines = [ls._terms(x) for x in (text or "").split("\n") if not re.search(ls.COPYRIGHT, x.lower())]
        lines = [x for x in lines if x]
        units = [(lines, 0)] if lines else []
        for j in range(len(lines)):
            for cap in (0, *sorted(set(caps))):
                e = j + 1
                while e < len(lines) and sum(sum(x.values()) for x in lines[j : e + 1]) <= cap:
                    e += 1
                units.append((lines[j:e], cap))
        best = (0.0, None)
        for u, cap in units:
            total = {}
            for x in u:
                for t, k in x.items():
                    total[t] = total.get(t, 0) + k
            for (name, t), own in zip(flat, caps, strict=True):
                if cap in (0, own) and (cap == 0 or set(u[0]) & set().union(*(x for (_, x), c in zip(flat, caps, strict=True) if c == cap))):
                    c = cosine(total, t)
                    if c >= ls.THRESHOLD and c > best[0]:
                        best = (c, name)
        out[path] = best
    return out


def test_license_scan_against_brute_force(spark, sf):
    files = [(f"{i}/{k}", t) for i, (k, t) in enumerate(_real_files().items())]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").select("doc_id", "text").collect()
    files += [(f"d/{r['doc_id']}", r["text"]) for r in docs]
    files += [("ties/x", "Released under the MIT License.\nReleased under the MIT License."), ("e/empty", ""), ("e/null", None), ("e/long", "lorem ipsum " * 30000 + "\nReleased under the MIT License.")]
    want = _brute_notice(files)
    got = {r["path"]: (r["cosine"], r["license"]) for r in ls.scan(spark.createDataFrame(files, "path string, text string")).where("origin = 'notice'").collect()}
    for path, (cosine, name) in want.items():
        if name is None:
            assert path not in got
        else:
            assert got[path][1] == name and got[path][0] == pytest.approx(cosine, abs=2e-6)


# --- op3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, None), ("", ""), ("a &amp; b", "a & b"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b", "a\nb"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table>lost<tr><td>in</table>", "lost\n\nin"), ("<p hidden>x</p>y", "y"), ("<p style='color:red; display : none'>x</p>y", "y"), ("<script>if (a<b) '</p>'</script>z", "z"),
        ("<title>t</title><body>b", "b"), ("<pre> a\n  b</pre>", " a\n  b"), ("x <b>y</b> z", "x y z"), ("<b>un<p>closed", "un\n\nclosed"), ("a<!-- c -->b", "ab"), ("<noscript>n</noscript>s", "s"),
        ("1 < 2 <3", "1 < 2 <3"), ("<a href='x>y'>l</a>", "l"), ("<details><summary>s</summary>d</details>", "s"), ("<select><option>a<option selected>b</select>", "b"), ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<svg><title>t</title><desc>d</desc><text x=1>one</text><text>two</text></svg>", "one two"), ("<math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>tex</annotation></math>", "a+b"),
        ("<div style='visibility:hidden'>x<b style='visibility: visible'>y</b>z</div>w", "y\nw"), ("<ul><li style=visibility:hidden>a<li>b</ul>", "- b"),
        ("<select multiple><option>a<option>b</select>", "a\nb"), ("<select size=3><optgroup label=G><option>a</optgroup></select>", "G\na"),
        ("<table><tr><a name=x></a><td>A<td>B<tr><td>CC<td>D</table>", "A  | B\nCC | D"), ("<table><tr><b>x<td>A<td>B</table>", "x\n\nA | B"), ("<table><tr><td>A</td><i>m</i><td>B</table>z", "m\n\nA | B\n\nz"),
        ("<textarea>&lt;k&gt;</textarea>", "<k>"), ("</p>", ""), ("<h1>a</h2>b", "a\n\nb"), ("<td>alone", "alone"), ("<p>a", "a"), ("<unfinished", ""),
    ],
)
def test_html_text(html, text):
    assert ht.extract(html) == text


def random_page(rng):
    """A page written with random liberties of the syntax, and its text, made from the same blocks without a parser."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    words = lambda n=4: [f"w{int(x)}" for x in rng.integers(0, 500, rng.integers(1, n + 1))]
    case = lambda t: pick(t, t.upper(), t.capitalize())
    space = lambda: pick("", " ", "\n", "\t ")

    def tag(name, implied=False):
        attrs = pick("", " class=a", " title='x > y'", ' data-k="<b>"')
        return f"<{case(name)}{attrs}>", "" if implied and pick(True, False) else f"</{case(name)}{pick('', ' ')}>"

    def inline(ws):
        out = []
        for w in ws:
            a, b = pick(("", ""), tag("b"), tag("span"), ("<!-- c -->", ""))
            out.append(a + pick(w, w, f"&#{ord(w[0])};{w[1:]}") + b)
        return pick(" ", "\n  ").join(out)

    html, blocks = [], []  # blocks: (margin, lines)
    for _ in range(int(rng.integers(1, 9))):
        kind = pick("p", "h2", "div", "ul", "ol", "table", "none", "pre")
        if kind in ("p", "h2", "div"):
            ws = words(6)
            a, b = tag(kind, kind == "p")
            html.append(a + space() + inline(ws) + space() + b)
            blocks.append((kind != "div", [" ".join(ws)]))
        elif kind in ("ul", "ol"):
            items, start = [words() for _ in range(int(rng.integers(1, 5)))], int(rng.integers(1, 20))
            a, b = (f"<ol start={start}>", "</ol>") if kind == "ol" else tag("ul")
            html.append(a + "".join(x + inline(ws) + y + space() for ws in items for x, y in [tag("li", True)]) + b)
            blocks.append((True, [("- " if kind == "ul" else f"{start + k}. ") + " ".join(ws) for k, ws in enumerate(items)]))
        elif kind == "table":
            wide = int(rng.integers(1, 4))
            rows = [[" ".join(words(2)) for _ in range(wide)] for _ in range(int(rng.integers(1, 4)))]
            body = ""
            for r in rows:
                a, b = tag("tr", True)
                body += a + space() + "".join(x + c + y for c in r for x, y in [tag("td", True)]) + b
            html.append(f"<table>{pick(body, '<tbody>' + body)}</table>")
            size = [max(len(r[k]) for r in rows) for k in range(wide)]
            blocks.append((True, [" | ".join(c.ljust(n) for c, n in zip(r, size, strict=True)).rstrip() for r in rows]))
        elif kind == "none":
            html.append(pick("<script>if (a < b) x('<p>')</script>", "<p hidden>no</p>", "<div style='display:none'>no<p>no</div>", "<!-- <p>no -->", "<style>p{}</style>"))
            if html[-1].startswith(("<p", "<div")):
                blocks.append((False, []))
        else:
            lines = ["  ".join(words(3)) for _ in range(int(rng.integers(1, 4)))]
            html.append("<pre>" + "\n".join(lines) + "</pre>")
            blocks.append((True, lines))
    text, last = [], None
    for margin, lines in blocks:
        if lines:
            text += ([""] if last is not None and (margin or last) else []) + lines
            last = margin
    return "".join(x + space() for x in html), "\n".join(text)


@pytest.mark.parametrize("seed", range(300))
def test_html_text_of_random_pages(seed):
    html, text = random_page(np.random.default_rng(seed))
    assert ht.extract(html) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abiptdrul=\"' !-&;\n", max_size=80))
def test_html_never_fails(html):
    ht.extract(html)


def test_html_depth_and_frame(spark):
    assert ht.extract("<div>" * 30000 + "x") == "x"
    df = spark.createDataFrame([(1, "<p>a", "k"), (1, "<p>a", "k"), (None, None, None)], "page_id long, html string, visible_text string")
    out = ht.page_texts(df)
    assert out.columns == ["page_id", "visible_text", "_visible_text"] and sorted(r[2] or "" for r in out.collect()) == ["", "a", "a"]
    assert ht.page_texts(df.limit(0)).count() == 0


# --- op4


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(WORD, low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abAB \t\n\x0bÉß  ", max_size=60))
def test_fingerprint(text):
    assert sh.fingerprint(text) == slow_fingerprint(text)


def brute_simhash(rows, budget=4):
    fp = [slow_fingerprint(t) for _, t in rows]
    label = np.arange(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= budget:
                unite(label, np.array([i]), np.array([j]))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, f"{fp[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_simhash_against_brute_force(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in sh.near_duplicates(odd).collect()), key=str) == brute_simhash(rows)


def test_trie_links_of_dense_and_hot_nodes(spark):
    rng = np.random.default_rng(8)
    centers = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([[c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False))) for _ in range(40)] for c in centers]).astype(np.uint64))
    label = np.arange(len(fp))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    unite(label, a, b)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for chunk in (8192, 8):
        edges = [(r["a"], r["b"]) for r in sh.trie_links(df, chunk=chunk).collect()]
        at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
        mine = np.arange(len(fp))
        unite(mine, np.array([at[x] for x, _ in edges]), np.array([at[y] for _, y in edges]))
        assert (mine == label).all()


@pytest.mark.parametrize("exact", [1, 2, 3])
def test_walk_finds_all_pairs_at_any_layout(exact):
    rng = np.random.default_rng(exact)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in (1, 3, 4, 5)]))
    want = np.arange(len(fp))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    unite(want, a, b)
    got = np.arange(len(fp))
    for order, deep in sh._layouts(exact, 4):
        path = sh._reordered(fp, order)
        rank = np.argsort(path)
        key = path[rank] >> np.uint64(64 - deep)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.append(start[1:], len(fp))
        label = np.arange(len(fp))
        sh.walk(path[rank], np.column_stack([start, end, start, end]), np.full(len(start), deep), 4, label, direct=1)
        unite(got, rank, rank[label])
    assert (got == want).all()


def test_keep_one(spark, odd, empty):
    groups = {(r[0], r[2]) for r in sh.near_duplicates(odd).collect()}
    kept = [r["doc_id"] for r in sh.keep_one(odd).collect()]
    assert sorted(kept, key=str) == sorted({d for d, c in groups if d == c}, key=str)
    assert sh.near_duplicates(empty).count() == 0 and sh.keep_one(empty).columns == empty.columns


# --- op5


def brute_windows(rows, span=50):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    starts = {}
    for d, w in words:
        for i in range(len(w) - span + 1 if d is not None else 0):
            k = tuple(w[i : i + span])
            starts[k] = min(d, starts.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - span + 1 if d is not None else 0):
            if starts[tuple(w[i : i + span])] < d:
                gone[i : i + span] = [True] * span
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [1 << 28, 1 << 22])
def test_windows_against_brute_force(spark, odd, cells):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in sd.dedup_windows(odd, most_cells=cells).collect()), key=str)
    assert got == brute_windows(rows)


def test_windows_with_a_full_sketch(spark, odd, monkeypatch):
    monkeypatch.setattr(sd, "_cells", lambda anchor, width: [np.zeros(len(anchor), np.int64)] * 2)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in sd.dedup_windows(odd).collect()), key=str) == brute_windows(rows)


def _thue_morse(n, a, b):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    rest = " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"{_thue_morse(n, 'a', 'b')} {rest}"), (2, f"{_thue_morse(n, 'b', 'a')} {rest}"), (3, f"{_thue_morse(n, 'b', 'a')} {rest}")]
    got = sorted(tuple(r) for r in sd.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_windows(rows) and [r[2] for r in got] == [0, 0, 50]


def test_windows_and_vectors_with_text_ids(spark):
    rng = np.random.default_rng(1)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 999, 70)) for _ in range(2))
    rows = [("k10", a), ("k9", a + " " + b), ("k1", b), (None, a), ("k2", None)]
    got = sorted((tuple(r) for r in sd.dedup_windows(spark.createDataFrame(rows, "doc_id string, text string")).collect()), key=str)
    assert got == brute_windows(rows)
    rows = [("v9", [1.0, 2.0], 1), ("v10", [1.0, 2.1], 1), ("v2", [1.0, -2.0], 1), (None, [1.0, 2.0], 1)]
    got = sorted((tuple(r) for r in cf.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int"), passes=60.0).collect()), key=str)
    assert got == brute_links(rows)


def test_windows_empty(empty):
    assert sd.dedup_windows(empty).count() == 0


# --- op6


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=5).astype(np.float32).tolist()) for k in range(200)] + [(200 + k, [0.5] * 5) for k in range(8)]
    rows += [(300, None), (301, [None] * 5), (302, [float("nan")] * 5), (303, [1.0] * 3), (304, [2.0] * 3), (None, [1.0] * 5), (305, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for shard, block in ((8192, 16384), (16, 5)):
        got = sorted(tuple(r) for r in kt.top_k(df, F.col("vec_id") % 4 == 0, shard_rows=shard, block=block, leaf=4).collect())
        good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
        want = []
        for i, v in good:
            if i % 4 == 0:
                best = sorted(((-int(v @ w), j) for j, w in good if j != i and len(w) == len(v)))[:5]
                want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
        assert got == sorted(want)


def test_top_k_of_empty_vectors_text_ids_and_shared_ids(spark):
    rows = [("b", []), ("a", []), ("c", [1.0, 2.0]), ("e", [1.0, 1.0]), ("d", [1.0, 1.0]), ("f", [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = sorted(tuple(r) for r in kt.top_k(df, F.col("vec_id").isin("b", "c"), k=2).collect())
    assert got == [("b", 1, "a", 0), ("c", 1, "d", 3 * 65536), ("c", 2, "e", 3 * 65536)]
    shared = spark.createDataFrame([(4, [1.0]), (4, [-1.0]), (5, [2.0]), (6, [-2.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r)[1:] for r in kt.top_k(shared, F.col("vec_id") == 4, k=2).collect())
    assert got == sorted([(1, 5, 2 * 65536), (2, 6, -2 * 65536), (1, 6, 2 * 65536), (2, 5, -2 * 65536)])


def test_top_k_empty(spark):
    assert kt.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


def test_products_of_large_numbers():
    a = np.array([[2**30, -(2**30)]])
    assert kt._products(a, a).tolist() == [[2**61]]


# --- op7


def brute_lines(rows, span=3, least_words=50):
    """Line by line: gone if a run over it that is long enough stands earlier; runs are all sizes, compared as text."""
    content = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        content.append([(i, x.strip(" \t\x0b\x0c\r")) for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")])

    def windows(c):
        for wide in range(1, span + 1):
            for i in range(len(c) - wide + 1):
                if wide == span or sum(len(re.findall(WORD, x)) for _, x in c[i : i + wide]) >= least_words:
                    yield tuple(x for _, x in c[i : i + wide]), c[i][0], c[i + wide - 1][0]

    first = {}
    for (d, _), c in zip(rows, content, strict=True):
        for k, a, _ in windows(c) if d is not None else ():
            first[k] = min(first.get(k, (d, a)), (d, a))
    out = []
    for (d, t), c in zip(rows, content, strict=True):
        lines, gone = [] if t is None else t.split("\n"), set()
        for k, a, b in windows(c) if d is not None else ():
            if first[k] < (d, a):
                gone |= set(range(a, b + 1))
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(3)
    pool = [f"line {k}" for k in range(6)] + ["", "  "]
    rows = [(k, "\n".join(rng.choice(pool, rng.integers(0, 14)))) for k in range(60)] + [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] not in (13, 14)]
    rows = [(d, t) for k, (d, t) in enumerate(rows) if k < 60 or d is None or d > 100] + [(200, None), (201, "a\nb\nc\r\nx\na\n\nb\n c")]
    long = [" ".join(rng.choice(pool[:6], 20)) for _ in range(4)]  # 40 words a line
    rows += [(300, f"q\n{long[0]}\n{long[1]}\nr"), (301, f"s\n{long[0]}\n{long[1]}\nt"), (302, long[2]), (303, long[2]), (304, long[3] + " " + long[2]), (305, "u\n" + long[3] + " " + long[2] + "\nv")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit(7))
    got = sorted(((r["doc_id"], r["text"], r["_n_lines"], r["n_removed"]) for r in ld.dedup_lines(df).collect()), key=str)
    assert got == brute_lines(rows)
    gone = {r[0]: r[3] for r in got}
    assert gone[301] == 2 and gone[303] == 0 and gone[305] == 1  # two lines of 40 words, one of 40, one of 80
    assert ld.dedup_lines(empty).count() == 0


# --- op8


def test_packing(spark, odd, empty):
    rows = odd.collect()
    out = pk.pack(odd, window=256, shard_bytes=4096).toPandas()
    encode = pk.Encoder(*pk.public_files())
    want = sorted((str(r["doc_id"]), len(encode(r["text"] or ""))) for r in rows)
    starts = out[out.start == 0]
    assert sorted((("None" if np.isnan(d) else str(int(d))), int(n)) for d, n in zip(starts.doc_id, starts.doc_tokens, strict=True)) == want
    assert out.length.sum() == sum(n for _, n in want)
    seq = out.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all()
    total = seq.groupby("sequence_id").length.sum()
    assert total.max() <= 256 and (np.bitwise_count(total.to_numpy()) == 1).all()
    one = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in (None, 13, 14)}
    for d, part in out[out.doc_id.isin(list(one))].sort_values("start").groupby("doc_id"):
        ids, at = encode(one[int(d)] or ""), 0
        for p in part.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert pk.pack(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_encoder_gives_the_ids_of_tokenizers(text):
    e = pk.encoder(pk.public_files())
    for t in (text, text + "<|endoftext|>" + text):
        assert e(t).tolist() == [*e.slow.encode(t, add_special_tokens=False).ids, 0]


def brute_bm25(texts):
    """scores[i][j]: BM25 of text j for the distinct words of text i; A-Z lowered; df, n and mean over the texts."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    n, mean = len(texts), sum(map(len, words)) / len(texts)
    df, counts = {}, [{} for _ in words]
    for c, w in zip(counts, words, strict=True):
        for x in w:
            c[x] = c.get(x, 0) + 1
        for x in c:
            df[x] = df.get(x, 0) + 1
    idf = {x: np.log(1 + (n - d + 0.5) / (d + 0.5)) for x, d in df.items()}
    return [[sum(idf[x] * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in q if x in c) for c, w in zip(counts, words, strict=True)] for q in counts]


def _corpus(rng, n=160):
    topics = [[f"t{k}x{j}" for j in range(30)] for k in range(12)]
    common = [f"c{k}" for k in range(15)]
    out = []
    for k in range(n):
        size = int(rng.integers(1, 120))
        out.append(" ".join(rng.choice(topics[k % 12] + common + common, size)) + f" Own{k}")
    return [*out, "", "OWN3 alone", out[5], out[5]]


def _statistics_of(texts):
    import pyarrow as pa

    sketch, words = np.zeros((2, 1 << pk.SKETCH_BITS), np.int64), 0
    for _, _, data, offsets in wh.slices(pa.array(texts)):
        for _, _, term, _, _, w in pk._terms(data, offsets):
            words += int(w.sum())
            for r, c in enumerate(pk._cells(term, pk.SKETCH_BITS)):
                np.add.at(sketch[r], c, 1)
    return pk.Statistics(len(texts), words, sketch, pk.SKETCH_BITS)


@pytest.mark.parametrize("dense", [2, 16, 10**6])
def test_scores_are_bm25(dense):
    import pyarrow as pa

    texts = _corpus(np.random.default_rng(dense))
    index, want = pk.Index(pa.array(texts), _statistics_of(texts), dense, 7), np.array(brute_bm25(texts))
    for k in range(len(texts)):
        got = index.scores(k)
        others = np.arange(len(texts)) != k  # terms of one document are left out: only its own score has them
        assert np.allclose(got[others], want[k][others])
        free = others & (np.arange(len(texts)) % 3 != 0)
        best, whole = index.neighbours(k, free, 5)
        ranked = sorted((-round(want[k][j], 9), j) for j in np.flatnonzero(free) if want[k][j] > 0)
        assert [-s for s, _ in ranked[:5]] == pytest.approx([want[k][j] for j in best]) and whole == (len(ranked) < 5)


def brute_packing(texts, lengths, window):
    """Greedy filling by full BM25 scores, plainly: [(document, tokens), ..] in the order in which they are laid."""
    score, free, order = brute_bm25(texts), set(range(len(texts))), []
    room, seed = window, None
    while free:
        near = [(-round(score[seed][j], 9), j) for j in free if score[seed][j] > 1e-12] if seed is not None else []
        doc = min(near)[1] if near else min(free)
        free.remove(doc)
        order.append(doc)
        if seed is None:
            seed = doc
        left = lengths[doc]
        while left:
            n = min(room, left)
            left, room = left - n, room - n
            if not room:
                room, seed = window, doc if left else None
    return order


def test_packing_follows_brute_force(spark):
    texts = [t for t in _corpus(np.random.default_rng(4), 60) if t][:-2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pk.pack(df, window=128).toPandas().sort_values(["sequence_id", "offset"])
    first = out[out.start == 0].doc_id.tolist()
    encode = pk.Encoder(*pk.public_files())
    # documents stand in the shard in the order of their keys; the brute force takes that order and does the rest by itself
    import pyarrow as pa

    data, offsets = next(iter(wh.slices(pa.array(texts))))[2:]
    _, d, t, size, _, w = next(iter(pk._terms(data, offsets)))
    keys = pk._keys(d, t, size, len(w))
    order = sorted(range(len(texts)), key=lambda k: (*(int(x[k]) for x in keys), k))
    laid = brute_packing([texts[k] for k in order], [len(encode(texts[k])) for k in order], 128)
    assert first == [order[k] for k in laid]


def test_neighbours_come_from_the_same_shard():
    rng = np.random.default_rng(6)
    texts = _corpus(rng, 600)
    import pyarrow as pa

    data, offsets = next(iter(wh.slices(pa.array(texts))))[2:]
    _, d, t, size, _, w = next(iter(pk._terms(data, offsets)))
    order = np.lexsort(pk._keys(d, t, size, len(w))[::-1])
    shard = np.empty(len(texts), np.int64)
    shard[order] = np.arange(len(texts)) // 60
    want = np.array(brute_bm25(texts))
    np.fill_diagonal(want, -1)
    best = want[:600].argmax(axis=1)
    assert (shard[best] == shard[:600]).mean() > 2 * 0.1  # by chance one in ten


def test_bm25_statistics_cover_the_corpus(spark, odd):
    for parts in (1, 3):
        stats = pk._statistics(pk._prepared(odd.repartition(parts).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash")), "bigint", 12), 12)
        rows = [(r["text"] or "").encode().split() for r in odd.collect()]
        assert stats.n == len(rows) and stats.mean == pytest.approx(sum(map(len, rows)) / len(rows))
        assert (stats.sketch.sum(axis=1) == sum(len(set(x.lower() for x in r)) for r in rows)).all()


# --- op9


def level_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark, odd, empty):
    rows = sm.mix_digest(odd).collect()
    again = sm.mix_digest(odd.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    plain = odd.collect()
    size = {}
    for r in plain:
        size[r["source"]] = size.get(r["source"], 0) + len(re.findall(WORD, r["text"] or ""))
    want = level_targets(size)
    by_size = {s: (n, want[s]) for s, n in size.items()}
    assert len(rows) == len(plain)
    taken = {}
    for r in rows:
        source = next(s for s, (n, t) in by_size.items() if n == r["source_size"] and abs(t - r["target"]) < 1e-6)
        taken[source] = taken.get(source, 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, t in want.items():
        assert abs(taken.get(s, 0) - t) <= 64
    assert sm.mix_digest(empty).count() == 0


def test_mixing_alike_with_many_sources(spark, odd, monkeypatch):
    want = sorted(map(str, sm.mix_digest(odd).collect()))
    monkeypatch.setattr(sm, "FEW", 1)
    assert sorted(map(str, sm.mix_digest(odd).collect())) == want


def test_mixed_documents_have_the_words_taken(spark, odd):
    taken = sum(r["taken"] for r in sm.mix_digest(odd).collect())
    out = sm.mixed_documents(odd)
    assert out.columns == odd.columns
    assert sum(len(re.findall(WORD, r["text"])) for r in out.collect()) == taken


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutations(spark, n):
    got = spark.range(n).select(sm.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1)).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


# --- op10


def test_ordinal_model_on_held_out_ratings(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ratings = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), oq.grade().alias("grade"))
    held = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) == 0
    model = oq.train(docs, ratings.where(~held))
    out = oq.scored(docs, model).join(ratings.where(held), F.col("doc_id") == F.col("id")).collect()
    assert all(np.diff(model.thresholds) > 0)
    assert np.mean([r["keep"] == (r["grade"] == 2) for r in out]) > 0.9
    for r in out:
        assert 0 <= r["tail_probability"] <= r["expected_grade"] <= 2


def test_scores_match_the_formula(spark, odd, empty):
    ratings = odd.where("doc_id is not null").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).cast("int").alias("grade"))
    model = oq.train(odd, ratings, least=1, steps=30)
    got = {(r["doc_id"], r["text"]): r["tail_probability"] for r in oq.scored(odd.withColumn("keep", F.lit(1)), model).collect()}
    import pyarrow as pa

    for (_, text), p in got.items():
        _, ends, feats = next(iter(oq.features(pa.array([text], pa.string()))))
        score = float(model.weights[feats].astype(np.float64).sum())
        assert p == pytest.approx(1 - 1 / (1 + np.exp(score - model.thresholds[1])), abs=1e-6)
    assert oq.scored(empty, model).count() == 0
    assert oq.train(empty, ratings).thresholds.shape == (2,)


def brute_features(text, bits):
    """The feature numbers of a text, by plain Python over its words and characters."""
    import math
    import string

    raw = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else 32 if chr(b) in string.punctuation else 48 if 48 <= b <= 57 else b for b in raw)
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)

    def number(h):
        return int(h) >> (64 - bits)

    out = [number(wh.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in sorted(set(words))]
    count = lambda f: sum(f(b) for b in raw)
    shares = [(count(lambda b: 65 <= b <= 90), len(raw)), (count(lambda b: 48 <= b <= 57), len(raw)), (count(lambda b: b in b"\t\n\x0b\x0c\r "), len(raw))]
    shares += [(raw.count(c.encode()), len(raw)) for c in string.punctuation]
    shares += [(sum(a == b for a, b in zip(words, words[1:])), len(words)), (len(words) - len(set(words)), len(words)), (len(raw), max(1, len(words)) * 64), (min(len(words), 4096), 4096)]  # noqa: B905
    for k, (part, whole) in enumerate(shares):
        b = 0 if not part else 1 + math.floor(2 * math.log2(max(part / max(whole, 1), 2**-12) * 4096))
        out.append(number(wh.mix(np.array([0xA5A5 + k * 1000 + b], np.uint64))[0]))
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB9 .,!\n\té", max_size=50), min_size=1, max_size=5))
def test_features_against_brute_force(texts):
    import pyarrow as pa

    for first, ends, feats in oq.features(pa.array(texts)):
        for k in range(len(ends) - 1):
            assert sorted(feats[ends[k] : ends[k + 1]].tolist()) == brute_features(texts[first + k], oq.SPACE_BITS)


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    feats = [rng.choice(40, 6, False) for _ in range(200)]
    hidden = rng.normal(size=40)
    y = np.digitize([hidden[f].sum() for f in feats], [-1.5, 1.5])
    ends = np.concatenate([[0], np.cumsum([len(f) for f in feats])])
    m = oq.OrdinalModel.fit(ends, np.concatenate(feats), y, bits=6, least=1, steps=400)
    tails = m.tails(ends, np.concatenate(feats))
    assert np.mean((tails >= 0.5).sum(axis=1) == y) > 0.9
