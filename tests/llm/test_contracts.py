"""The registered queries against independent brute force on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from upslope.llm import queries as Q

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").toPandas().to_dict("records")


def rows(spark, sf_dir, name, key="doc_id"):
    return {r[key]: r.asDict() for r in Q.queries()[name](spark, sf_dir).collect()}


def words(text):
    return WORD.findall((text or "").encode())


def lowered(text):
    return [w.lower() for w in words(text)]


def test_secret_scan(spark, small, docs):
    got = rows(spark, small, "op1_secret_scan")
    kinds = {
        "assign": re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    fits = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    some = 0
    for d in docs:
        spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(kinds.items()) for m in p.finditer(d["text"] or "") if fits[k](m)]
        r = got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()
        for k in kinds:
            assert r[f"n_{k}"] == sum(s.startswith(k) for *_, s in spans)
        assert {s for *_, s in spans} <= set(r["spans"].split(",")) | {""}
        some += len(spans)
    assert some and len(got) == len(docs)


def test_ngram_join(spark, small, docs):
    got = rows(spark, small, "op2_ngram_jaccard_join")
    sets = {}
    for d in docs:
        w = lowered(d["text"])
        sets[d["doc_id"]] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    for i in ids:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["n_links"]) == (len(sets[i]), find(i), links[i])
    assert links


def test_mix_sources(spark, small, docs):
    got = rows(spark, small, "op3_mix_sources")
    size = Counter()
    for d in docs:
        size[d["source"]] += len(words(d["text"]))
        assert got[d["doc_id"]]["size"] == len(words(d["text"]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    taken, largest = Counter(), Counter()
    for d in docs:
        r, s = got[d["doc_id"]], d["source"]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] in {0, r["size"], 2 * r["size"]}
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    top = max(largest.values())
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s] + top
    again = rows(spark.newSession(), small, "op3_mix_sources")
    assert again == got


def test_quality_rules(spark, small, docs):
    got = rows(spark, small, "op4_quality_rules")
    for d in docs:
        text = (d["text"] or "").encode()
        w = WORD.findall(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split(b"\n") if WORD.search(x)]
        want = {
            "n_words": len(w),
            "word_chars": sum(len(x.decode()) for x in w),
            "n_symbols": sum(c in "#*$%&|<>" for c in (d["text"] or "")),
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
            "n_repeat_words": len(covered),
            "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
        }
        r = got[d["doc_id"]]
        assert {k: r[k] for k in want} == want
        assert not (want["base_failed"] and r["kept"])


def test_shards(spark, small, docs):
    got = rows(spark, small, "op7_shards")
    slots = defaultdict(list)
    for d in docs:
        r, text = got[d["doc_id"]], (d["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_hold_the_documents(spark, small, docs, tmp_path, monkeypatch):
    path = str(tmp_path / "shards")
    monkeypatch.setattr(Q, "new_path", lambda *_: path)
    got = rows(spark, small, "op7_shards")
    kept = spark.read.parquet(path).collect()
    assert len(kept) == len(docs)
    want = {d["doc_id"]: d for d in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in kept:
        assert all(r[c] == v for c, v in want.pop(r.doc_id).asDict().items())
        assert (r.shard, r.slot) == (got[r.doc_id]["shard"], got[r.doc_id]["slot"])


def test_lm_scoring(spark, small, docs):
    got = rows(spark, small, "op6_gru_scoring")
    out = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs}
    c = Counter()
    for d in docs:
        if not out[d["doc_id"]]:
            c.update([*lowered(d["text"]), None])
    n, v = sum(c.values()), len(c)
    for d in docs:
        tokens, r = [*lowered(d["text"]), None], got[d["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d["doc_id"]], len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_records(spark, small, docs):
    from tokenizers import Tokenizer

    got = rows(spark, small, "op9_token_records")
    t = Tokenizer.from_file(Q.TOKENIZER)
    at = 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(packed))
        at += len(ids)


def test_url_filter(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = rows(spark, small, "op5_url_filter", "page_id")
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    for p in pages:
        _, found, rest = (p["url"] or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if found else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if found else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(fit, key=len, default=None)
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, rules.get(rule, "allow"))
