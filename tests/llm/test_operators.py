"""Each operator against a plain version, the library, an exact round trip, or held-out labels."""

import hashlib
import itertools
import json
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skarn.llm import balls, bpe, components, decontam, html, langid, licenses, pii, quality, queries, shards, similar, simhash, urls


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_op1_rules_and_trees(spark):
    pages = [(1, "http://a.com/x"), (2, "http://www.EXAMPLE.com/en/1"), (3, "https://m.example.com/en/2?a=1"), (4, "http://q.net/es/1"), (5, "http://q.net/en/1"), (6, "http://com/"), (7, "http://xcom/"), (8, "http://x.com?p=/"), (9, "http://b.www.example.com/en/#t"), (10, None)]
    rules = urls.parse_rules(queries.RULES)
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert [found[i].rule for i in range(1, 11)] == ["com/", "www.example.com/en/", "example.com/en/", "net/es/", None, "com/", None, None, "www.example.com/en/", None]
    assert [found[i].verdict for i in (1, 2, 3, 4, 6, 9)] == ["allow", "allow", "block", "block", "allow", "allow"]
    assert (found[8].host, found[8].path) == ("x.com", "") and found[9].path == "/en/"


def plain_rule(url):
    head, _, rest = (url or "").partition("://") if url and "://" in url else ("", "", "")
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in ("com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/") if (host + ".").endswith("." + (h := r.split("/")[0]) + ".") or host == h]
    fits = [r for r in fits if path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_op1_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in queries.op1_urls(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        r = found[p.page_id]
        assert (r.host, r.path, r.rule) == plain_rule(p.url)
        if r.rule:
            assert r.verdict == ("allow" if r.rule in ("com/", "www.example.com/en/") else "block")


def test_op1_held_out(spark):
    """Trees of four parts of the labelled URLs, held against the fifth.

    The rules' verdicts hang on a path's first folder too, which is none of the lexical features: no more can be told.
    """
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    _, labelled, _ = urls.labelled_rows(pages, urls.parse_rules(queries.RULES))
    labelled = urls.with_fold(labelled)
    model = urls.fit(labelled.filter("fold > 0").drop("fold"))
    found = [(r.label, r.probability) for r in model.probability(labelled.filter("fold = 0")).collect()]
    block, allow = [p for x, p in found if x], [p for x, p in found if not x]
    auc = sum((b > a) + 0.5 * (b == a) for b in block for a in allow) / (len(block) * len(allow))
    right = sum((p >= urls.LEAST) == (x > 0.5) for x, p in found) / len(found)
    print("held out", len(found), "auc", auc, "accuracy", right)
    assert auc > 0.65


def test_op1_learns(spark):
    rng = random.Random(3)
    rows = [(i, f"http://{'w' if i % 2 else 'shop'}{i}.org/{'a/' * (6 if i % 2 else 1)}{rng.randint(0, 99)}") for i in range(400)]
    data = urls.with_features(urls.with_parts(spark.createDataFrame(rows, "page_id long, url string")))
    model = urls.fit(data.filter("page_id < 300").withColumn("label", F.when(F.col("page_id") % 2 == 1, 1.0).otherwise(0.0)))
    right = model.blocked(data.filter("page_id >= 300")).filter(F.col("blocked") == (F.col("page_id") % 2 == 1)).count()
    assert right >= 95


def test_op2_equals_library(spark, docs, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["Σ ΑΣ. İ ŉ", "a" * 3000 + "b" * 70, "x<|endoftext|>y <|startoftext|>", "12345 ½²③ x́", "日本 'S'T 'LL", "\x1c\x85​﻿", "😀👍🏽 ﬁ ẞ", "!!!???...---"]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(odd, 10**6)), "doc_id long, text string"))
    found = by_id(bpe.encode(more, public_tokenizers.path("word_bpe_49k.json")))
    for r in more.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(found[r.doc_id].ids, "<u4").tolist() == ids
        assert found[r.doc_id].decoded == library.decode(ids, skip_special_tokens=False)
    digest = by_id(queries.op2_bpe(spark, sf))
    assert all(digest[i].ids_sha256 == hashlib.sha256(found[i].ids).hexdigest() and digest[i].n_tokens * 4 == len(found[i].ids) for i in digest)


def test_op2_merges_like_a_plain_loop():
    vocab = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    pairs = {tuple(m): i for i, m in enumerate(map(tuple, json.loads(vocab.source)["model"]["merges"]))}
    at = {t: i for i, t in enumerate(vocab.tokens)}

    def plain(word):
        parts = [*word[:-1], word[-1] + bpe.WORD_END]
        while True:
            ranks = [(pairs[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in pairs]
            if not ranks:
                return [at[p] for p in parts]
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 45))) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocab.encode_words(words)] == [plain(w) for w in words]


def test_op3_finds_and_inherits(spark):
    apache, gpl = "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    body = "plain words of a text " * 40
    files = [(1, "r/LICENSE", apache), (2, "r/src/a.c", body), (3, "r/src/COPYING", gpl), (4, "r/src/deep/b.c", body), (5, "r/src/c.c", body + "\n" + apache), (6, "q/d.c", body), (7, None, gpl), (8, "r/e.c", "see the license of the warranty you like best, dear reader")]
    found = by_id(licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")))
    told = {i: (r.license, r.origin, r.inherited_from) for i, r in found.items()}
    assert told == {1: ("Apache-2.0", "own", None), 2: ("GPL-3.0-only", "inherited", "r/src"), 3: ("GPL-3.0-only", "own", None), 4: ("GPL-3.0-only", "inherited", "r/src"), 5: ("Apache-2.0", "own", None), 6: (None, "none", None), 7: ("GPL-3.0-only", "own", None), 8: ("Apache-2.0", "inherited", "r")}


def test_op3_hard_wrapped(spark):
    """Each template's longest text, wrapped, as a file, as comment headers, and as a paragraph of a long text."""
    import textwrap

    body = "plain words of a text " * 400
    files, told = [], {}
    for name, given in licenses.TEMPLATES.items():
        lines = textwrap.wrap(max(given, key=len), 60)
        shapes = {
            "LICENSE": "\n".join(lines),
            "a.c": "\n".join(["/*", *(f" * {x}" for x in lines), " */", body]),
            "b.c": "\n".join(["/*", *lines, "*/", body]),
            "c.py": "\n".join([*(f"# {x}" for x in lines), body]),
            "d.txt": "\n".join([body, "", *lines, "", body]),
        }
        for file, text in shapes.items():
            told[len(files)] = name
            files.append((len(files), f"{name}/{file}", text))
    found = by_id(licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")))
    assert {i: (r.license, r.origin) for i, r in found.items()} == {i: (name, "own") for i, name in told.items()}


def test_op3_scores_by_hand(spark):
    one = spark.createDataFrame([("k", "released under the mit license today", 2)], "key string, block string, n long")
    got = licenses.score_blocks(one, 0.0).first()
    told = [(x, Counter(licenses.terms_of(t))) for x, ts in licenses.TEMPLATES.items() for t in ts]
    block = Counter("released under the mit license today".split())
    idf = {w: math.log((1 + len(told) + 2) / (1 + sum(w in t for _, t in told) + 2 * (w in block))) + 1 for w in set(block).union(*(t for _, t in told))}
    norm = lambda t: math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items()))
    best = max((sum(n * block[w] * idf[w] ** 2 for w, n in t.items()) / norm(t) / norm(block), x) for x, t in told)
    assert got.license == best[1] == "MIT" and abs(got.score - best[0]) < 1e-8


def plain_scan(files):
    """License scan of (doc_id, path, text) in plain Python: cosine of every block to every template, then ancestors."""
    blocks = {(i, p): [b for b in licenses.blocks_of(t, p) if b[2]] for i, p, t in files}
    count = Counter(b[2] for found in blocks.values() for b in found)
    told = [(x, Counter(licenses.terms_of(t))) for x, ts in licenses.TEMPLATES.items() for t in ts]
    df = Counter()
    for words, n in [(Counter(b.split()), n) for b, n in count.items()] + [(t, 1) for _, t in told]:
        for w in words:
            df[w] += n
    weight = {w: math.log((1 + sum(count.values()) + len(told)) / (1 + n)) + 1 for w, n in df.items()}
    norm = lambda t: math.sqrt(sum((n * weight[w]) ** 2 for w, n in t.items()))
    scores = {}
    for block in count:
        words = Counter(block.split())
        every = [(-round(sum(n * words[w] * weight[w] ** 2 for w, n in t.items()) / norm(t) / norm(words), 9), x) for x, t in told]
        if (best := min(every))[0] <= -licenses.LEAST:
            scores[block] = best
    own, dirs = {}, {}
    for i, p, t in files:
        hits = [(low, high, b, *scores[b]) for low, high, b in blocks[i, p] if b in scores]
        wider = lambda h: [o for o in hits if o[0] <= h[0] and o[1] >= h[1] and o[1] - o[0] > h[1] - h[0]]  # noqa: E731, B023
        hits = [(h, wider(h)) for h in hits if all(o[4] == h[4] for o in wider(h))]
        if hits:
            own[i, p] = score, name = min((h[3], h[4]) for h, _ in hits)
            share = sum(len(h[2].split()) for h, outer in hits if not outer) / len(licenses.terms_of(t))
            if p is not None and (share >= licenses.FILE_SHARE or re.match("(?i)(un)?licen[sc]e|copying", p.rsplit("/", 1)[-1])):
                folder = p.rpartition("/")[0]
                dirs[folder] = min(dirs.get(folder, (1, "")), (score, name))
    out = {}
    for i, p, _ in files:
        up = None if p is None else p.rpartition("/")[0]
        while up is not None and up not in dirs:
            up = up.rpartition("/")[0] if up else None
        if (i, p) in own:
            out[i] = (own[i, p][1], -own[i, p][0], "own", None)
        elif up is not None:
            out[i] = (dirs[up][1], -dirs[up][0], "inherited", up)
        else:
            out[i] = (None, None, "none", None)
    return out


def test_op3_equals_brute_force(spark, sf, texts):
    """The whole table by its query, then with license files planted in some folders of the tree."""
    found = queries.op3_licenses(spark, sf).collect()
    files = [(r.doc_id, r.path, texts[r.doc_id]) for r in found]
    folders = sorted({p.rsplit("/", n)[0] for _, p, _ in files for n in (1, 2, 3)})
    notices = [t for given in licenses.TEMPLATES.values() for t in given]
    planted = [(10**6 + i, f"{f}/{('LICENSE', 'notice.txt')[i % 2]}", notices[i % len(notices)] + " plain words" * (i % 7)) for i, f in enumerate(folders) if i % 3]
    more = licenses.scan(spark.createDataFrame(files + planted, "doc_id long, path string, text string")).collect()
    assert {r.origin for r in more} == {"own", "inherited", "none"}
    for rows, told in ((found, plain_scan(files)), (more, plain_scan(files + planted))):
        for r in rows:
            license, score, origin, up = told[r.doc_id]
            assert (r.license, r.origin, r.inherited_from) == (license, origin, up)
            assert r.score == score or abs(r.score - score) < 1e-7


def test_op3_on_documents(spark, sf, texts):
    found = by_id(queries.op3_licenses(spark, sf))
    for i, text in texts.items():
        assert (found[i].origin == "own") == bool(re.search("(?m)^(Licensed under|Released under|This work is licensed)", text or ""))


def test_op4_held_out(spark):
    found = queries.op4_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = found.count(), found.filter("lang = lang_pred").count()
    assert n > 200 and right >= 0.99 * n


def test_op4_sums_all_segmentations():
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    chance = rng.random((len(pieces), 2))
    model = langid.Model(pieces, ["a", "b"], chance / chance.sum(axis=0))
    at = {p: i for i, p in enumerate(pieces)}

    def plain(word, lang):
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            ends = [i for i, c in enumerate(cuts, 1) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            total += math.prod(model.chance[at[p], lang] if p in at else langid.UNKNOWN if len(p) == 1 else 0 for p in parts)
        return math.log(total)

    words = ["▁the", "▁nation", "▁xqß", "▁été", "▁日本", "▁ungener"]
    assert np.allclose(model.score(words), [[plain(w, g) for g in (0, 1)] for w in words])
    uses = model.expected(words[:2], np.array([0, 1]), np.array([1.0, 3.0]))
    assert abs(sum(uses[i].sum() * len(p) for i, p in enumerate(pieces)) - (len(words[0]) + 3 * len(words[1]))) < 1e-3


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_op4_long_pieces_and_runs():
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert {"▁children", "▁different", "▁important"} <= set(pieces)
    rng = np.random.default_rng(1)
    chance = rng.random((len(pieces), 2)) + 0.1
    model = langid.Model(pieces, ["a", "b"], chance / chance.sum(axis=0))
    at = {p: i for i, p in enumerate(pieces)}

    def plain(word, lang):
        alpha = [0.0]
        for j in range(1, len(word) + 1):
            ways = [alpha[i] + math.log(model.chance[at[word[i:j]], lang] if word[i:j] in at else langid.UNKNOWN) for i in range(max(0, j - 20), j) if word[i:j] in at or j == i + 1]
            alpha.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
        return alpha[-1]

    words = ["▁children", "▁importantbusiness", "▁" + "differentchildren" * 40, "▁" + "ß日qx" * 30, "▁the" + "x" * 37, "▁" + "é" * 23, "▁" + "é" * 24, "▁abc"]
    assert langid.marked("a" * 5000) == "▁" + "a" * 5000
    assert np.allclose(model.score(words), [[plain(w, g) for g in (0, 1)] for w in words], rtol=1e-9)
    for word in words[:3]:
        uses = model.expected([word, "▁abc"], np.array([1, 0]), np.array([2.0, 0.0]))
        assert math.isclose(sum(uses[i, 1] * len(p) for i, p in enumerate(pieces)), 2 * len(word), rel_tol=1e-6)
        some = next(i for i in np.argsort(-uses[:, 1]) if len(pieces[i]) > 8)
        more = model.chance.copy()
        more[some, 1] *= 1 + 1e-6
        slope = (langid.Model(pieces, ["a", "b"], more).score([word])[0, 1] - model.score([word])[0, 1]) / 1e-6
        assert math.isclose(uses[some, 1], 2 * slope, rel_tol=1e-3)


def test_op5_base_spans(spark, sf, texts):
    rng = random.Random(0)
    for _ in range(20_000):
        text = "".join(rng.choice("01259.@-+ ()ab_%.\n@9é") for _ in range(rng.randint(0, 40)))
        assert [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text) if s["base"]] == plain_spans(text)
    for r in queries.op5_pii(spark, sf).collect():
        told = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in told).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(t[0] == k for t in told) for k, _ in BASE]


def test_op5_checksums_context_and_masks():
    kinds = lambda t: [s["kind"] for s in pii.spans_of(t)]
    assert kinds("bank GB82 WEST 1234 5698 7654 32 ok") == ["iban"] and kinds("bank GB83 WEST 1234 5698 7654 32 ok") == []
    for following in ("AND MORE", "BIC COBADEFF", "12 34", "", ", DE"):
        assert [pii.masked(f"bank GB82 WEST 1234 5698 7654 32 {following}"), pii.masked(f"IBAN DE89370400440532013000 {following}")] == [f"bank [IBAN] {following}", f"IBAN [IBAN] {following}"]
    assert kinds("GB82WEST12345698765432X") == [] and kinds("DE89 3704 0044 0532 0130 00 FR14 2004 1010 0505 0001 3M02 606") == ["iban", "iban"]
    assert kinds("phone 555-123-4567 now") == ["national_phone"] and kinds("part order phone 555-123-4567 now") == []
    assert kinds("call 555-123-4567 now") == ["national_phone"] and kinds("part 555-123-4567 now") == []
    assert pii.masked("mail a@b.co or +1 (297) 555-8151.") == "mail [EMAIL] or [PHONE]."
    assert pii.masked(None) is None


def test_op6_files(spark, sf, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["  b\n\n  c \n", "x<|endoftext|>y <|endoftext|>", "it's 'S ''s", "\x1c \x85 a", "日本 ½", "  \n<|endoftext|>  z"]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(odd, 10**6)), "doc_id long, text string"))
    made = shards.write_shards(more, path, folder=str(tmp_path))
    found, at = by_id(shards.read_shards(made)), 0
    for r in more.orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        assert found[r.doc_id].start == at and found[r.doc_id].ids == struct.pack(f"<{len(ids)}I", *ids)
        at += len(ids)
    for row in made.collect():
        reader = shards.Reader(row.path)
        every = {shards.id_of(k): i for k, _, i in reader}
        assert all(reader.get(k) == [v] for k, v in every.items())
        assert sum(bool(reader.get(10**9 + k)) for k in range(200)) == 0
    digest = by_id(queries.op6_shards(spark, sf))
    assert all(r.ids_crc32 == zlib.crc32(found[i].ids) for i, r in digest.items())


def test_op6_format(tmp_path):
    path = str(tmp_path / "one.sst")
    writer = shards.Writer(path)
    keys = [None, None, -5, 3, 3, 3, 70_000]
    for n, k in enumerate(keys):
        writer.add(shards.key_of(k), struct.pack("<2I", n, 1 << 20) * (40_000 if n % 2 else 1))
    writer.close()
    reader = shards.Reader(path)
    assert [shards.id_of(k) for k, _, _ in reader] == keys and len(reader.index) > 2
    assert [len(reader.get(k)) for k in (None, -5, 3, 70_000, 4)] == [2, 1, 3, 1, 0]
    with open(path, "r+b") as f:
        f.truncate(100)
    with pytest.raises(ValueError):
        shards.Reader(path)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, twice, inside, lines, dup = Counter(zip(words, words[1:], words[2:], strict=False)), 0, set(), set(), 0
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside) + twice


def test_op7_counts_and_votes(spark, texts):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("ab c\n\n \t#|é \x1c\x85") for _ in range(rng.randint(0, 60)))
        assert quality.counts(text)[:5] == plain_counts(text)
    assert all(quality.counts(t)[:5] == plain_counts(t) for t in texts.values())
    sf = "/root/testdata/sf0.01"
    found = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    told = {(r.quality, r.kept): r["count"] for r in found.filter("n_words >= 50").groupBy("quality", "kept").count().collect()}
    assert told.get((1, True), 0) >= 0.98 * (told.get((1, True), 0) + told.get((1, False), 0))
    assert told.get((0, False), 0) >= 0.9 * (told.get((0, True), 0) + told.get((0, False), 0))


def test_op7_estimates_planted_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right = np.where(good[:, None], [0.95, 0.9, 0.85, 0.97], [0.8, 0.7, 0.9, 0.6])
    votes = np.where(rng.random(right.shape) < right, 1, -1) * np.where(good, 1, -1)[:, None] * (rng.random(right.shape) < 0.8)
    accuracy, share, posterior = quality.estimate(votes.astype(float), np.ones(len(votes)))
    assert np.abs(accuracy - [[0.95, 0.9, 0.85, 0.97], [0.8, 0.7, 0.9, 0.6]]).max() < 0.05 and abs(share - 0.8) < 0.03
    assert ((posterior >= 0.5) == good).mean() > 0.93


def test_op8_layout():
    page = "<head><title>no</title></head><p>a<p>b <b>c</b>d<ul><li>x<li>y<ul><li>z</ul></ul><ol start=3><li>q<li>r</ol><table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table><div style='display: none'>no</div><script>'<p>no'</script><pre>a\n  b</pre>t &amp; <span hidden>no</span>e<br>next"
    assert html.visible_text(page).split("\n") == ["a", "", "b cd", "", "- x", "- y", "    - z", "", "3. q", "4. r", "", "Name      | Qty", "apple pie | 3", "", "a", "  b", "", "t & e", "next"]


@pytest.mark.parametrize(("page", "told"), [
    ("<div>" * 3000 + "<div style='display:none'>SECRET</div>seen", "seen"),
    ("<span aria-hidden=true>icon</span><textarea>\n a  b</textarea>", "icon a  b"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b><table><tr><td>no<td style='visibility: visible'>cell</table></div>", "yes\n\ncell"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
    ("<ol start=1000><li>a<li value=7>b<li>c</ol><ol reversed><li>a<li>b</ol>", "1000. a\n7. b\n8. c\n\n2. a\n1. b"),
    ("<style>.x{display:none} p.y, q{visibility:hidden} @media print{div{display:none}} #k{display:none!important}</style><div class=x>no</div><div class='x' style='display:block'>yes</div><p class=y>no<p>ok<i id=k style='display:inline'>no</i>", "yes\n\nok"),
    ("<title>t</title><span>in</span><a>line</a>", "inline"),
    ("<head><meta charset=x>text<li>q", "text\n- q"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
    ("<table>" + "<tr><td rowspan=150>a<td>b" + "<tr><td>c" * 149 + "<tr><td>d<td>e</table>", "a | b\n" + "  | c\n" * 149 + "d | e"),
    ("<table><tr><td colspan=150>w<td>v<tr>" + "<td>" * 150 + "<td>u</table>", "w | v\n  | u"),
    ("<table><tr><td>" * 300 + "deep", "deep"),
    ("<ul><li><p>a</p><p>b</p></li><li></li><li>c</ul>after", "- a\n\n  b\n- c\n\nafter"),
])
def test_op8_visibility_and_layout(page, told):
    assert html.visible_text(page) == told


def test_op8_deep_and_long_pages():
    for page in ("<div>" * 30_000, "<ul><li>" * 2000, "<blockquote>" * 5000, "<table><tr><td>" * 2000, "<p>" * 50_000):
        assert html.visible_text(page + "x<p>last").split()[-1] == "last"


def plain_render(page):
    """A second renderer, without a tree, for what the table's pages hold: lines at blocks, blanks at paragraphs, marks at items."""
    from html import unescape

    page = re.sub(r"(?s)<head.*?</head>|<(script|style).*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", page)
    lines, now, mark, blank, inside = [], "", "", False, False

    def flush(force=False):
        nonlocal now, mark, blank
        if now.split() or force:
            lines.extend([""] * (blank and bool(lines)) + [mark + " ".join(now.split())])
            mark, blank = "  " if mark else "", False
        now = ""

    for token in re.findall(r"<[^>]*>|[^<]+", page):
        tag = re.match(r"</?([a-z0-9]+)|", token)[1]
        if token[0] != "<":
            now += unescape(token)
        elif tag == "br":
            flush(force=True)
        elif tag not in ("a", "b"):
            flush()
            blank |= inside or tag in ("p", "ul", "h1")
            inside = token.startswith("<p")
            mark = "- " if token.startswith("<li") else "" if tag in ("li", "ul") else mark
    flush()
    return "\n".join(lines)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op8_equals_second_renderer(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    found = pages.join(queries.op8_html(spark, f"/root/testdata/{folder}"), "page_id").collect()
    assert len(found) == pages.count() and all(r.text == plain_render(r.html) for r in found)


def test_op8_keeps_all_visible_words(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in pages.join(html.extract(pages), "page_id").collect():
        bare = re.sub(r"(?s)<head.*?</head>|<!--.*?-->|<[^>]*>", " ", r.html)
        words = Counter(re.findall(r"[^\W_]{3,}", re.sub(r"&[a-z]+;", " ", bare)))
        assert not words - Counter(re.findall(r"[^\W_]{3,}", r.text))


def test_op9_equals_brute_force(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id): r.containment for r in decontam.contained_items(docs, items).collect()}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 0)
    assert found == {(r.doc_id, r.item_id): r.containment for r in decontam.contained_items(docs, items).collect()}
    runs = lambda w: {*zip(*(w[i:] for i in range(5)), strict=False)}
    told = {}
    wanted = {r.item_id: runs(decontam.words_of(r.text)) for r in items.collect()}
    for d in docs.collect():
        here = runs(decontam.words_of(d.text))
        told |= {(d.doc_id, i): len(w & here) / len(w) for i, w in wanted.items() if len(w & here) >= 0.8 * len(w)}
    assert found == told and len(told) > 10


def test_op9_partial_containment_and_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 90)))) for i in range(60)]
    rows = []
    for i, text in items:
        w = text.split()
        for cut in (0, 1, 3, 6):
            rows.append((len(rows), " ".join(rng.choices(words, k=300) + w[: len(w) - cut] + rng.choices(words, k=300))))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    told = {(d, i) for d, t in rows for i, x in items if len(runs(x.split()) & runs(t.split())) >= 0.8 * len(runs(x.split()))}
    assert {(r.doc_id, r.item_id) for r in decontam.contained_items(docs, bench).collect()} == told
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(decontam, "AT_ONCE", 2)
    assert decontam._one_block(decontam._items(bench)) is None
    assert {(r.doc_id, r.item_id) for r in decontam.contained_items(docs, bench).collect()} == told
    assert {r.doc_id for r in decontam.decontaminated(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in told}


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    told = plain_components(pairs, {x for p in pairs for x in p})
    assert found == {n: r for n, r in told.items() if n != r}


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    import xxhash

    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_op10_equals_brute_force(spark, texts, sf):
    found = by_id(queries.op10_simhash(spark, sf))
    marks = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{m:016x}" for i, m in marks.items()}
    pairs = [(a, b) for a, b in itertools.combinations(marks, 2) if (marks[a] ^ marks[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in found.items()} == plain_components(pairs, marks)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_op10_dense_clusters(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(6)
    marks = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        marks += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(60)]
    marks = sorted({simhash._signed(m) for m in marks})
    nodes = spark.createDataFrame([(m,) for m in marks], "fp long")
    close = {r.node: r.root for r in components.connected_components(simhash.close_links(nodes)).collect()}
    far = simhash.far_links(spark.createDataFrame([(m, close.get(m, m)) for m in marks], "fp long, cls long"))
    links = [(r.a, r.b) for r in far.collect()] + list(close.items())
    unsigned = lambda x: x & (1 << 64) - 1
    pairs = [(a, b) for a, b in itertools.combinations(marks, 2) if (unsigned(a) ^ unsigned(b)).bit_count() <= 3]
    assert plain_components(links, marks) == plain_components(pairs, marks)


def test_pipeline_near_copies(spark):
    """The stage against brute force: links of five-word similarity 0.8 or more, no others."""
    import corpus_pipeline

    rng = random.Random(8)
    told = {}
    for group in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 200]))]
        for copy in range(5):
            words = list(base)
            for _ in range(copy * len(base) // 100):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            told[group * 5 + copy + 1] = " ".join(words)
    sets = {i: {*zip(*(t.split()[k:] for k in range(5)), strict=False)} for i, t in told.items()}
    near = [(a, b) for a, b in itertools.combinations(told, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    marks = {i: plain_fingerprint(t) for i, t in told.items()}
    assert any(told[a] != told[b] and (marks[a] ^ marks[b]).bit_count() > 3 for a, b in near)
    docs = spark.createDataFrame([(i, t) for i, t in told.items()], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(plain_components(near, told).values())


@pytest.mark.parametrize("crowd, part", [(similar.CROWD, similar.PART), (1, 8)])
def test_pipeline_near_copies_in_crowds(spark, monkeypatch, crowd, part):
    """A hub whose variants are alike to it but not to each other, and pairs within a crowd that shares a passage."""
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "PART", part)
    rng = random.Random(9)
    told: dict[int, str] = {}
    hub = [f"h{rng.randrange(9000)}" for _ in range(250)]
    for i in range(120):
        words = list(hub)
        for at in rng.sample(range(0, 250, 10), 5 if i else 0):
            words[at] = f"y{rng.randrange(9000)}"
        told[1000 - i] = " ".join(words)
    passage = [f"p{rng.randrange(9000)}" for _ in range(150)]
    for i in range(150):
        own = [f"z{rng.randrange(90000)}" for _ in range(75)]
        for copy in range(2):
            words = passage + own
            words[-1 - copy * 9] = "x"
            told[2000 + 2 * i + copy] = " ".join(words)
    sets = {i: {*zip(*(t.split()[k:] for k in range(5)), strict=False)} for i, t in told.items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(told), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = plain_components(near, told)
    assert len({*roots.values()}) < 200 and max(Counter(roots.values()).values()) > 100
    docs = spark.createDataFrame(list(told.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == {*roots.values()}


@pytest.mark.parametrize("crowd", [64, 2])
def test_pipeline_near_copies_by_simhash(spark, monkeypatch, crowd):
    """Fingerprints and balls do the stage's work: near copies go though no text has a MinHash band."""
    monkeypatch.setattr("skarn.llm.balls.CROWD", crowd, raising=False)
    marks_of = similar.marks_of
    monkeypatch.setattr(similar, "marks_of", lambda *a: marks_of(*a).withColumn("bands", F.expr("filter(bands, b -> false)")))
    rng = random.Random(10)
    told = {}
    for group in range(150):
        words = [f"w{rng.randrange(9000)}" for _ in range(200)]
        told[group] = " ".join(words)
        for at in (20, 70, 120, 170):
            words[at] = f"x{rng.randrange(9000)}"
        told[1000 + group] = " ".join(words)
    docs = spark.createDataFrame([*told.items(), (5000, None), (5001, ""), (5002, "one")], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept - set(told) == {5000, 5002} and set(range(150)) <= kept
    assert len(kept) <= 152 + 6


def plain_ball(block: int, how: balls.Plan) -> set[int]:
    """Variants of a block, one by one: its bits with up to two of the four least certain turned."""
    value, unsure = block & (1 << how.bits) - 1, [block >> 32 + 5 * i & 31 for i in range(4)]
    return {value ^ sum(1 << at for at in some) for n in range(3) for some in itertools.combinations(unsure, n)}


def test_pipeline_balls_are_few_and_meet():
    """Pairs of similarity 0.8 meet in a block, and a million texts make fewer than a hundred variants each."""
    how = balls.plan(10**6, 0.8)
    assert how.blocks * len(plain_ball(0b11_00010_00001_00000 << 32, how)) <= 100
    rng = np.random.default_rng(11)
    met = 0
    for _ in range(300):
        values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        one, other = (balls.fingerprint(x, how).tolist() for x in (values[:270], values[30:]))
        met += any(plain_ball(a, how) & plain_ball(b, how) for a, b in zip(one[1:], other[1:], strict=True))
    assert met >= 290


@pytest.mark.parametrize("crowd", [balls.CROWD, 3])
def test_pipeline_balls_equal_brute_force(spark, monkeypatch, crowd):
    """Variants of up to ``CROWD`` texts give all their pairs, the others each of their texts, and no more."""
    monkeypatch.setattr(balls, "CROWD", crowd)
    rng = np.random.default_rng(12)
    how = balls.plan(400, 0.8)
    prints = {}
    for group in range(8):
        base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
        for copy in range(50):
            own = rng.integers(0, 1 << 63, 5 + copy, dtype=np.uint64)
            prints[group * 50 + copy] = balls.fingerprint(np.concatenate([base, own]), how).tolist()
    roots = {i: i // 4 * 4 for i in prints if i % 8 < 4}
    met: dict[tuple[int, int], set[int]] = {}
    for i, numbers in prints.items():
        for b, block in enumerate(numbers[1:]):
            for v in plain_ball(block, how):
                met.setdefault((b, v), set()).add(i)
    cls = lambda i: roots.get(i, i)
    near = lambda a, b: cls(a) != cls(b) and ((prints[a][0] ^ prints[b][0]) & (1 << 64) - 1).bit_count() <= how.most
    want = {(a, b) for m in met.values() if len(m) <= crowd for a, b in itertools.combinations(sorted(m), 2) if near(a, b)}
    want |= {(i, i) for m in met.values() if len(m) > crowd and len({*map(cls, m)}) > 1 for i in m}
    table = spark.createDataFrame([(i, *numbers) for i, numbers in prints.items()], "node long, " + ", ".join(f"f{i} long" for i in range(1 + how.blocks)))
    found = balls.ball_pairs(table, spark.createDataFrame(list(roots.items()), "node long, root long"), how).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert {a == b for a, b in want} == {True, False}


@pytest.mark.parametrize("rows", [10**6, 0])
def test_pipeline_near_copies_on_documents(spark, sf, monkeypatch, rows):
    """Every row counts: brute force over the whole table with repeated rows, shared doc_ids and null ones planted."""
    from skarn.llm import common

    monkeypatch.setattr(common, "small", lambda table, _=0: F.broadcast(table) if rows else table)
    monkeypatch.setattr(simhash, "small", common.small)
    monkeypatch.setattr(similar, "small", common.small)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.filter("doc_id % 5 = 0").withColumn("doc_id", F.lit(7).cast("long")))
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id % 7 = 0"))
    keys = {(r.doc_id, r.text): r.key for r in docs.withColumn("key", F.xxhash64("text")).collect()}
    told = list(keys)
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in told]
    sets = [{*zip(*(w[k:] for k in range(5)), strict=False)} if len(w) > 5 else {tuple(w)} for w in words]
    near = [(i, j) for i, j in itertools.combinations(range(len(told)), 2) if words[i] == words[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups: dict[int, list[int]] = {}
    for i, root in plain_components(near, range(len(told))).items():
        groups.setdefault(root, []).append(i)
    order = lambda i: (told[i][0] is None, told[i][0] or 0, keys[told[i]])
    best = sorted((told[min(g, key=order)] for g in groups.values()), key=repr)
    assert len(best) > 100 and sorted(((r.doc_id, r.text) for r in simhash.keep_first(docs).collect()), key=repr) == best


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert kept.count() <= before.count()
    ids = {r.doc_id for r in kept.collect()}
    first = by_id(queries.op10_simhash(spark, sf))
    leaks = {r.doc_id for r in queries.op9_decontamination(spark, sf).collect()}
    told = {i for i, r in first.items() if r.component_id == i} - leaks
    assert ids <= told and len(told - ids) <= 5
    assert all(not plain_spans(r.text) for r in kept.collect())
    final = by_id(corpus_pipeline.run(spark, sf))
    assert set(final) == ids and all(r.n_tokens * 4 == len(r.ids) for r in final.values())
