"""Nulls, empty tables, repeated rows, clashing columns and planted cases for each operator."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from upslope.llm import decontamination, line_dedup, lm_scoring, mixing, ngram_join, quality, records, secrets, sharding, url_filter
from upslope.llm import queries as Q
from upslope.scratch import materialize, new_path

SCHEMA = "doc_id long, text string, source string, size int, node string, h string, bucket int, id int"
LONG = " ".join(f"word{i}" for i in range(300))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts, with columns named like the operators' own."""
    rows = [
        (1, LONG, "a"),
        (1, LONG, "a"),
        (2, None, "a"),
        (3, "", None),
        (None, " \n\t ", "b"),
        (None, LONG + " tail", None),
        (4, "one", "a"),
        (5, "one two", ""),
        (6, LONG * 200, "b"),
        (7, "ä  x \x1c y", "\U0001f600"),
    ]
    return spark.createDataFrame([(*r, 1, "n", "h", 2, 3) for r in rows], SCHEMA)


OPERATORS = {
    "secrets": lambda d: secrets.secret_report(d),
    "ngrams": lambda d: ngram_join.near_duplicates(d),
    "mix": lambda d: mixing.mix_sources(d),
    "quality": lambda d: quality.quality_report(d),
    "lm": lambda d: lm_scoring.score_documents(d),
    "shards": lambda d: sharding.shard_records(d),
    "records": lambda d: records.record_report(d, Q.TOKENIZER),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_one_row_each(odd, name):
    assert OPERATORS[name](odd).count() == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_reruns_agree_for_other_partitions(odd, name):
    first = sorted(map(str, OPERATORS[name](odd).collect()))
    assert sorted(map(str, OPERATORS[name](odd.repartition(5)).collect())) == first


def test_ngram_classes_of_odd_rows(odd):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(odd).collect()]
    assert got.count((1, 296, 1, 3)) == 2
    assert (None, 297, 1, 3) in got and (6, 301, 1, 3) in got and (2, 0, 2, 0) in got and (None, 0, None, 0) in got and (4, 1, 4, 0) in got


def test_ngram_blocks_equal_one_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[:k % 25] + [f"x{k}"] + base[k % 25 + 1 :])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = ngram_join.materialize(ngram_join._node_table(docs, "doc_id", "text", 5), "t")
    whole = {r.node: (r.links,) for r in ngram_join.similar_sets(nodes, 80).collect()}
    cut = {r.node: (r.links,) for r in ngram_join.similar_sets(nodes, 80, block_shingles=700).collect()}
    assert whole == cut and len(whole) > 40
    assert len({r.component for r in ngram_join.similar_sets(nodes, 80, block_shingles=700).collect()}) == len({r.component for r in ngram_join.similar_sets(nodes, 80).collect()})


def test_drop_near_duplicates_keeps_columns_and_clean_rows(spark, odd):
    kept = ngram_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 1, 2, 3, 4, 5, 7]


def test_ngram_split_groups_equal_brute_force(spark):
    """Near copies of three sizes, more than a group may have in one task."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(420):
        words = base[: 60 - 5 * (k % 3)]
        words = [w if rng.random() > 0.015 else f"y{rng.randrange(40)}" for w in words]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    near = {i: [j for j in range(len(sets)) if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(sets))}
    seen = {}
    for i in near:
        todo, reach = [i], {i}
        while todo:
            new = set(near[todo.pop()]) - reach
            reach |= new
            todo += new
        seen[i] = (min(reach), len(near[i]))
    assert got == seen and len({c for c, _ in seen.values()}) > 3


def test_drop_near_duplicates_decides_by_id_and_text(spark):
    near = LONG.replace("word150 ", "other ")
    rows = [(5, LONG, 1), (5, near, 2), (5, "clean text of its own", 3), (None, LONG, 4), (None, "only null id " + LONG[:900], 5), (None, "only null id " + LONG[:905], 6), (None, None, 7), (7, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for limit in (0, 1000):
        kept = sorted(r.n for r in ngram_join.drop_near_duplicates(docs, broadcast_rows=limit).collect())
        assert len(kept) == 5 and {3, 7, 8} <= set(kept) and len({1, 2} & set(kept)) == 1 and len({5, 6} & set(kept)) == 1
    assert ngram_join.drop_near_duplicates(docs.limit(0)).count() == 0


def test_secrets_link_only_within_a_scope(spark):
    weak = 'user = "admin" and password=hunter22'
    rows = [(1, weak), (2, "password=hunter22 alone"), (3, 'user = "admin"' + " x" * 300 + " password=hunter22"), (4, 'user = "admin"\n\npassword=hunter22'), (5, None)]
    got = {r.doc_id: r.spans for r in secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "account:0:13,weak_assign:19:36"
    assert [got[k] for k in (2, 3, 4, 5)] == [""] * 4
    redacted = secrets.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").first().text
    assert redacted == '[SECRET]" and [SECRET]'


def brute_spans(text, reach=200):
    """Every pair of parts is tried."""
    parts = []
    for k, p in enumerate(secrets.PATTERNS):
        for m in re.finditer(p.regex, text, re.ASCII):
            if p.min_value <= len(m.group(p.value_group)) <= p.max_value:
                parts.append((m.start(), m.end(), k, p))

    def linked(p, q):
        overlap = p[0] < q[1] and q[0] < p[1]
        between = text[min(p[1], q[1]) : max(p[0], q[0])]
        beside = not overlap and len(between) <= reach and "\n\n" not in between
        return q[3].role in secrets.COMPLEMENTS[p[3].role] and (beside or overlap and "endpoint" in (p[3].role, q[3].role))

    return ",".join(f"{p[3].kind}:{p[0]}:{p[1]}" for p in sorted(parts, key=lambda x: x[:3]) if p[3].strong or any(linked(p, q) for q in parts))


def test_secrets_inside_an_endpoint_are_linked(spark):
    url = "https://api.host/v1?api_key=abc12345"
    rows = [(1, url), (2, "see https://api.host/v1 only"), (3, 'x https://h.org/?api_key="abc12345" y')]
    got = {r.doc_id: r.spans for r in secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "endpoint:0:36,weak_assign:20:36", 2: "", 3: "endpoint:2:25,weak_assign:17:34"}


def test_secrets_find_partners_behind_many_inner_parts(spark):
    url = "https://h.org/?" + "&".join(["user=bob"] * 700)
    rng = random.Random(5)
    pieces = [" ", "\n\n", "x" * 90, "https://h.org/?a=b&", "user=bob", "&token=abcdef", " password=hunter22", "AKIA12345", " secret=AKIA12345", "0123456789abcdef", '"']
    texts = [url + " x" * 20 + " password=hunter22", *("".join(rng.choices(pieces, k=rng.randrange(2, 25))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_report(df).collect()}
    assert got[0].startswith("endpoint:0:")
    for k, text in enumerate(texts):
        assert got[k] == brute_spans(text), text


def test_secrets_in_a_text_with_very_many_matches(spark):
    text = " ".join(f"user=bob{i} AKIA{i:08d}" for i in range(8000)) + "\n\npassword=hunter22"
    rows = spark.createDataFrame([(1, text), (2, text.replace("\n\n", " "))], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_report(rows).collect()}
    assert got[1] == "" and got[2].endswith(f"weak_assign:{len(text) - 18}:{len(text) - 1}")


def test_quality_filter_passes_columns_through(odd):
    kept = quality.quality_filter(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, None} | {r.doc_id for r in quality.quality_report(odd).where("kept").collect()}


def test_cascade_stops_at_the_first_rejection(spark):
    plain = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "short") for i in range(60)] + [(100 + i, plain + " #" * 60) for i in range(5)] + [(200, plain)]
    report = quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string"), count_asked=True).collect()
    n_rules = len(quality.default_rules())
    got = {r.doc_id: r for r in report}
    assert got[200].kept and got[200].n_asked == n_rules
    assert all(not got[i].kept and got[i].n_asked < n_rules for i in range(60))
    assert not got[100].kept and not got[100].base_failed and got[100].n_words == 140


def test_cascade_counts_only_what_earlier_rules_leave():
    rules = [quality.Rule(n, None) for n in "abc"]
    ordered = quality.greedy_order(rules, [1.0, 1.0, 1.0], {0b011: 50, 0b010: 1, 0b100: 10, 0: 39})
    assert [r.name for r in ordered] == ["b", "c", "a"] and [r.rate for r in ordered] == [0.51, 0.1, 0.0]


def test_cascade_order_does_not_change_the_verdict(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rules = quality.default_rules()
    a = sorted(quality.quality_report(docs, rules=rules).where("kept").select("doc_id").collect())
    b = sorted(quality.quality_report(docs, rules=rules[::-1]).where("kept").select("doc_id").collect())
    assert a == b
    ordered = quality.order_rules(docs, "text", rules)
    gain = [r.rate / max(r.cost, 1e-9) for r in ordered]
    assert gain == sorted(gain, reverse=True)


def planted_pages(spark):
    link, refresh = '<link rel="canonical" href="{}">', "<meta http-equiv='refresh' content='0; url={}'>"
    rows = [
        (1, "http://foo.com", link.format("http://b.org/1")),
        (2, "http://foo.com/", None),
        (3, "http://b.org/1", refresh.format("http://x.example.com/en/3")),
        (4, "http://c.org/a/b", link.format("d")),
        (5, "http://c.org/a/d", link.format("https://y.net/es/x")),
        (6, "http://c.org/d", ""),
        (7, "http://e.org", link.format("f?q=1")),
        (8, "http://e.org/f?q=1", refresh.format("//z.net/fr/")),
        (9, "http://g.org/h", link.format("http://g.org/h")),
        (10, None, link.format("http://y.net/es/x")),
        (11, "http://b.org/1", None),
        (12, "http://k.org/#top", link.format("http://foo.com/")),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_planted_links_equal_sql(spark):
    import duckdb

    from upslope.llm import sql

    pages = planted_pages(spark)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({sql.oracle_sql()['op5_url_filter']})").fetchall())
    for parts in (1, 7):
        assert sorted(map(tuple, url_filter.judge_urls(pages.repartition(parts)).collect())) == want
    verdicts = {r[0]: r[4] for r in want}
    assert [verdicts[k] for k in (1, 3, 4, 5, 6, 7, 8, 9)] == ["allow", "allow", "block", "block", "allow", "block", "block", "allow"]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    extra = pages.selectExpr("*", "1 host", "'x' rule", "2 node", "3 src", "true verdict")
    assert sorted(map(tuple, url_filter.judge_urls(extra).collect())) == want


def test_redirect_classes(spark):
    link = '<html><head><link rel="canonical" href="{}"></head></html>'
    rows = [
        (1, "http://a.org/x", link.format("http://bad.example.com/en/1")),
        (2, "http://b.org/y#top", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'),
        (3, "http://www.example.com/en/2", link.format("http://bad.example.com/en/9")),
        (4, "http://c.org/z", link.format("http://www.example.com/en/2")),
        (5, "http://clean.org/", "<p>canonical</p>"),
        (6, None, None),
        (7, "http://d.org/k", link.format("/m")),
        (8, "https://d.org/m?", link.format("//bad.example.com/en/4")),
    ]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == (None, "block") and got[2] == (None, "block")
    assert got[3] == ("www.example.com/en/", "allow")
    assert got[4] == (None, "allow"), "an explicit allow in the class wins"
    assert got[5] == (None, "allow") and got[6] == (None, "allow")
    assert got[7] == (None, "allow"), "/m and /m? are different addresses"


def test_decontamination_tolerates_substitutions(spark):
    item = [f"b{i}" for i in range(40)]
    changed = [w if i % 7 else "zzz" for i, w in enumerate(item)]
    rows = [
        (1, "x " * 30 + " ".join(item) + " y" * 30),
        (2, " ".join(f"k{i}" for i in range(50)) + " " + " ".join(changed)),
        (3, LONG),
        (4, " ".join(item[:8])),
        (5, None),
        (6, " ".join(w.upper() + "," for w in item[10:26])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.matches for r in decontamination.find_overlaps(docs, bench).collect()}
    assert set(found) == {(1, 9), (2, 9), (6, 9)} and found[1, 9] == 40 and found[6, 9] == 16
    blocks = {(r.doc_id, r.item_id): r.matches for r in decontamination.find_overlaps(docs, bench, block_bytes=64).collect()}
    assert blocks == found
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()) == [3, 4, 5]
    assert decontamination.find_overlaps(docs, bench.limit(0)).count() == 0


def brute_overlaps(words, item):
    """The verified overlap of a text and an item, every diagonal tried, words compared as they are."""
    n, least = len(item), decontamination.LEAST_WORDS
    masks = ["1" * n] if n < least else [*decontamination.SEEDS, *(m for m, most in decontamination.SHORT_SEEDS if n <= most)]
    best = None
    for offset in range(1 - n, len(words)):
        lo, hi = max(0, offset), min(len(words), offset + n)
        same = [words[p] == item[p - offset] for p in range(lo, hi)]
        hit = any(all(same[a + k] for k, c in enumerate(m) if c == "1") for m in masks for a in range(len(same) - len(m) + 1))
        if not hit:
            continue
        spans = [(sum(same[a:b]), a, b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1]]
        spans = [(m, 3 * m - 2 * (b - a), a, b) for m, a, b in spans if 3 * m > 2 * (b - a)]
        enough = n if n < least else min(13, -(-7 * n // 10))
        top = max(spans, key=lambda s: (s[1], -s[2]))
        if top[0] < enough:
            top = max(spans, key=lambda s: s[0])
        if top[0] >= enough and (best is None or (top[0], -(lo + top[2])) > (best[0], -best[1])):
            best = (top[0], lo + top[2], lo + top[3])
    return best


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = {k: [f"w{rng.randrange(60)}" for _ in range(n)] for k, n in enumerate([1, 2, 4, 5, 6, 7, 9, 12, 15, 18, 19, 25, 40])}
    docs = []
    for k in range(130):
        item = items[k % len(items)]
        part = item[rng.randrange(2) : len(item) - rng.randrange(2)] if len(item) > 8 else item
        rate = (0, 0, 0.07, 0.15, 0.25)[k % 5]
        part = [f"z{rng.randrange(9)}" if rng.random() < rate else w for w in part]
        docs.append((k, " ".join([f"f{rng.randrange(900)}" for _ in range(rng.randrange(30))] + part + [f"f{rng.randrange(900)}" for _ in range(rng.randrange(30))])))
    docs += [(200, None), (201, ""), (202, docs[3][1]), (202, docs[3][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(3, " ".join(items[3]))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.matches) for r in decontamination.find_overlaps(table, bench).collect())
    want = sorted((d, k, found[0]) for d, t in docs for k, item in items.items() if (found := brute_overlaps((t or "").split(), item)))
    assert got == want and {k for _, k, _ in want} == set(items)
    exact = {(r.doc_id, r.item_id): (r.start_word, r.end_word) for r in decontamination.find_overlaps(table, bench).collect()}
    for d, t in docs[:130]:
        whole = items[d % len(items)]
        if f" {' '.join(whole)} " in f" {t} ":
            a, b = exact[d, d % len(items)]
            assert t.split()[a:b] == whole
    assert decontamination.find_overlaps(table.limit(0), bench).count() == 0


def test_decontamination_decides_by_row(spark):
    item = " ".join(f"b{i}" for i in range(40))
    rows = [(None, item), (None, "clean text"), (1, item), (1, "clean too"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    for broadcast_rows in (0, 100):
        kept = decontamination.drop_contaminated(docs, bench, broadcast_rows=broadcast_rows).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "clean text"), (1, "clean too"), (2, "")]


def test_decontamination_asks_less_of_short_items(spark):
    item = [f"s{i}" for i in range(15)]
    cases = [(1, 7), (1, 13), (2, 6, 11), (2, 5, 8, 11), (1, 4, 7, 10, 13)]
    docs = [(k, " ".join(["a b c", *("zzz" if i in gone else w for i, w in enumerate(item)), "d e f"])) for k, gone in enumerate(cases)]
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    found = decontamination.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r.doc_id: r.matches for r in found.collect()} == {0: 12, 1: 11, 2: 12, 3: 11}, "ten of fifteen are too few"


def test_decontamination_tries_every_stretch_of_a_diagonal():
    same = np.array([1] * 12 + [0] * 13 + [1] * 7 + [0] * 2 + [1] * 6, bool)
    assert decontamination.best_stretch(same, 2) == (12, 0, 12)
    assert decontamination.dense_stretch(same, 2) == (13, 25, 40)
    item = np.arange(1, 41, dtype=np.uint64)
    text = np.where(same, item, np.uint64(0))
    assert decontamination.Index([9], [item], decontamination.SEEDS).overlaps(text, 13, 2) == {0: (13, 25, 40)}


def test_decontamination_seeds_meet_all_substitutions_in_short_items():
    for n in range(6, 16):
        item = np.arange(1, n + 1, dtype=np.uint64)
        index = decontamination.Index([9], [item], decontamination.SEEDS)
        for gone in combinations(range(n), n - decontamination.needed(n, 13)):
            text = item.copy()
            text[list(gone)] = 0
            assert (0, 0) in index.hits(text), (n, gone)


def test_line_dedup(spark):
    page = "<html><head><title>t</title></head><body><nav>Home</nav><p>text {}</p><script>x</script><p>Home</p></body></html>"
    rows = [(i, "http://Site.org/a", page.format(i)) for i in range(8)] + [(50 + i, f"http://s{i}.org/", page.format(i)) for i in range(3)] + [(90, None, None)]
    got = {r.page_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[3].host, got[3].n_lines, got[3].n_dropped, got[3].text) == ("site.org", 3, 2, "text 3")
    assert got[50].n_dropped == 0 and got[90].n_lines == 0 and len(got) == len(rows)


def test_records_round_trip_and_checksums(spark, odd):
    path = new_path(spark, "round")
    manifest = records.write_records(odd, path, Q.TOKENIZER, file_bytes=2000)
    listed = manifest.collect()
    assert sum(m.docs for m in listed) == odd.count() and len(listed) > 1
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    m = listed[-1]
    with store.open_input_file(f"{root}/{m.file}.rec") as f:
        data = f.read()
    at, payloads = 0, []
    while at < len(data):
        payload, at = records.unframe(data, at)
        payloads.append(payload)
    assert records.fetch_record(path, m.file, m.docs - 1) == payloads[-1]
    broken = bytearray(data)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(broken), 0)


def test_encoder_equals_the_library_on_hard_spacing():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(Q.TOKENIZER), records.Encoder(Q.TOKENIZER, cache_bytes=500)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\tb c", "don't stop", " x  y z", "x <|endoftext|> y", "中 文", "1 2  3   4", "a\x1c b", "é ö "]
    import numpy as np

    for _ in range(2):
        assert [np.frombuffer(x, e.width).tolist() for x in e.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_library_on_random_text():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(Q.TOKENIZER), records.Encoder(Q.TOKENIZER, cache_bytes=20_000)
    rng = random.Random(11)
    letters = "aZé ñ's 09 .,;!?-_ \t\n\r\x0b\x1c\u0085\u00a0\u1680\u2003\u2028\u3000\u200b中\U0001f600\u0301"
    for _ in range(12):
        texts = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(150)]
        assert [x.tolist() for x in e.encode([x.encode() for x in texts])] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode([None, b"\xff\xfe a"])] == [[], t.encode("\ufffd\ufffd a", add_special_tokens=False).ids]


def test_mixed_documents_repeat_rows(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 8 else "b", i) for i in range(10)], "doc_id long, text string, source string, taken int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.where("source = 'b'").count() == 4 or out.where("source = 'b'").count() == 3
    assert 13 <= out.count() <= 15


def plain_shards(docs, n_shards, seed, bucket_rows, hashes):
    """Buckets by hash, an ordinary Fisher-Yates shuffle of each, equal cuts; ``hashes`` are Spark's."""
    n_buckets = max(1, -(-len(docs) // bucket_rows))
    buckets = [sorted(d for d in docs if d[0] % n_buckets == b) for b in range(n_buckets)]
    order = []
    for b, rows in enumerate(buckets):
        out = []
        for i, row in enumerate(rows):
            j = hashes[b, i] % (i + 1)
            out.append(row)
            out[i], out[j] = out[j], row
        order += out
    n = len(order)
    cuts = [-(-s * n // n_shards) for s in range(n_shards)]
    return {row: (s := at * n_shards // n, at - cuts[s]) for at, row in enumerate(order)}


def test_shards_equal_a_plain_shuffle(spark):
    rows = [(i % 300, f"text {i % 300}", i) for i in range(500)] + [(None, None, 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    keyed = docs.selectExpr("doc_id id", "coalesce(octet_length(text), 0) + 8L size", "crc32(cast(coalesce(text, '') as binary)) crc")
    keyed = keyed.groupBy("id", "size", "crc").count().selectExpr("id", "size", "crc", "explode(sequence(0L, count - 1)) copy")
    keyed = [tuple(r) for r in keyed.selectExpr("xxhash64(7, id, size, crc, copy) h", "coalesce(id, -1L)", "size", "crc", "copy").collect()]
    draws = spark.range(30).selectExpr("id b", "explode(sequence(0, 60)) i").selectExpr("b", "i", "xxhash64(7, b, i) h").collect()
    want = plain_shards(keyed, 5, 7, 30, {(r.b, r.i): r.h for r in draws})
    want = sorted((k[1], k[2], k[3], *v) for k, v in want.items())
    for parts, aqe in ((1, "true"), (4, "true"), (7, "false"), (211, "true")):
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = sharding.shard_records(docs.repartition(parts), 5, seed=7, bucket_rows=30).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == want


def test_copies_of_one_row_spread_over_all_shards(spark):
    docs = spark.createDataFrame([(1, "same")] * 9000 + [(2, "a")] * 3 + [(i, f"t{i}") for i in range(10, 3000)], "doc_id long, text string")
    wide = sharding.shard_records(docs, carry=["text"], bucket_rows=100)
    for placed in (sharding.shard_records(docs, bucket_rows=100), wide):
        held = {r.shard: r.n for r in placed.where("doc_id = 1").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        assert len(held) == 24 and min(held.values()) > 150
        assert placed.select("shard", "slot").distinct().count() == docs.count()


def test_shards_carry_columns_that_clash(spark, odd):
    placed = sharding.shard_records(odd, 3, carry=[c for c in odd.columns if c != "doc_id"])
    assert {"source", "node", "h", "bucket", "id", "text"} <= set(placed.columns) and placed.count() == odd.count()
    assert sorted(str((r.doc_id, r.text, r.source, r.node, r.h, r.bucket, r.id)) for r in placed.collect()) == sorted(str((r.doc_id, r.text, r.source, r.node, r.h, r.bucket, r.id)) for r in odd.collect())


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i}") for i in range(50)], "doc_id long, text string, source string")
    placed = sharding.shard_records(docs, 4, carry=["text", "source"])
    assert all(r.text == f"t{r.doc_id}" and r.source == f"s{r.doc_id}" for r in placed.collect())
    back = sharding.write_shards(placed, str(tmp_path / "shards"))
    assert back.columns == placed.columns and sorted(back.collect()) == sorted(placed.collect())
    assert sharding.write_shards(placed.limit(0), str(tmp_path / "none")).count() == 0
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().agg(F.max("count")).first()[0] == 13


def test_shards_written_in_order_are_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(i % 900, f"t{i % 900}", f"s{i}") for i in range(1000)] + [(None, None, "s")] * 40, "doc_id long, text string, source string")
    want = sorted(map(str, sharding.shard_records(docs, 4, carry=["text", "source"], bucket_rows=20).collect()))
    placed = sharding.shard_records(docs, 4, carry=["text", "source"], bucket_rows=20, in_order=True)
    back = sharding.write_shards(placed, str(tmp_path / "shards"), in_order=True)
    assert sorted(map(str, back.collect())) == want
    files = back.groupBy(F.input_file_name(), "shard").agg((F.max("slot") - F.min("slot") + 1 - F.count("*")).alias("gaps")).collect()
    assert len(files) >= 4 and not any(f.gaps for f in files)
    assert sharding.write_shards(sharding.shard_records(docs.limit(0), carry=["text"], in_order=True), str(tmp_path / "none"), in_order=True).count() == 0


PAGES = "page_id long, url string, html string, host string, lines string, kept string, bad_host string, node string, src string, rule string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    """Nulls, repeated rows, a long page and columns named like the operators' own."""
    nav = "<nav>Home</nav>"
    rows = [(i, f"http://a.org/{i}", f"{nav}<p>own {i}</p>") for i in range(12)]
    rows += [(3, "http://a.org/3", f"{nav}<p>own 3</p>"), (None, None, None), (20, "", ""), (21, "no scheme", nav), (22, "http://b.org/x", "<p>" + "long line " * 20_000 + "</p>"), (23, None, f"{nav}<p>x</p>")]
    return spark.createDataFrame([(*r, "h", "l", "k", "b", "n", "s", "r") for r in rows], PAGES)


@pytest.mark.parametrize("name", ["urls", "lines"])
def test_odd_pages_give_one_row_each(odd_pages, name):
    run = {"urls": url_filter.judge_urls, "lines": line_dedup.dedup_lines}[name]
    first = sorted(map(str, run(odd_pages).collect()))
    assert len(first) == odd_pages.count()
    assert sorted(map(str, run(odd_pages.repartition(5)).collect())) == first
    assert run(odd_pages.limit(0)).count() == 0


def test_lines_at_the_ratio_stay(spark):
    def site(host, pages, held):
        return [(f"http://{host}/{i}", "<p>menu</p><p>own</p>".replace("own", f"own {i}") if i < held else f"<p>only {i}</p>") for i in range(pages)]

    rows = site("tie.org", 60, 6) + site("over.org", 60, 7) + site("few.org", 12, 4)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    dropped = {r.host: r.n for r in line_dedup.dedup_lines(df).groupBy("host").agg(F.sum("n_dropped").alias("n")).collect()}
    assert dropped == {"tie.org": 0, "over.org": 7, "few.org": 0}, "a tenth is not more than a tenth, and four pages are too few"


def test_decontamination_of_odd_rows(odd):
    bench = odd.sparkSession.createDataFrame([(1, LONG, "x"), (1, LONG, "x"), (None, " ".join(LONG.split()[:30]), "y"), (2, None, "z")], "item_id long, text string, matches string")
    found = sorted((r.doc_id or 0, r.item_id or 0, r.matches) for r in decontamination.find_overlaps(odd, bench).collect())
    assert found == sorted([(1, 1, 300), (1, 1, 300), (1, 0, 30), (1, 0, 30), (0, 1, 300), (0, 0, 30), (6, 1, 299), (6, 0, 30)])
    kept = decontamination.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 7]


def test_redaction_of_odd_rows(odd):
    out = secrets.redact_secrets(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))


def test_mix_serves_equal_finish_times_in_a_fixed_order(spark):
    """Equal sizes in equal sources finish at equal times."""
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    first = sorted(map(str, mixing.mix_sources(docs, weights=(1, 1)).collect()))
    assert sorted(map(str, mixing.mix_sources(docs.repartition(7), weights=(1, 1)).collect())) == first
    assert mixing.mix_sources(docs, weights=(1, 1)).agg(F.sum("taken")).first()[0] == 600
    same = spark.createDataFrame([(None, "w " * 10, "a")] * 300 + [(i, "w " * 5, "b") for i in range(50)], "doc_id long, text string, source string")
    assert mixing.mix_sources(same).where("taken > 0").count() > 150


def test_passage_that_no_task_holds_twice_makes_no_group(spark, monkeypatch):
    """A passage of many texts whose documents lie in tasks of their own is found by the counts over all tasks."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(100)]
    rows = [(i, f"{t} {passage}") for i, t in enumerate(texts)] + [(1000 + i, f"{texts[i]} {passage} extra") for i in range(3)]
    docs = spark.createDataFrame(rows + [(2000 + i, f"{texts[4]} copy") for i in range(70)], "doc_id long, text string")
    nodes = materialize(ngram_join._node_table(docs, "doc_id", "text", 4), "test-sets")
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    monkeypatch.setattr(ngram_join, "_frequent", lambda nodes: nothing)
    sets = list({r.node: np.frombuffer(r.items, np.uint64) for r in nodes.collect()}.values())

    def longest(order):
        return np.unique(np.concatenate([ngram_join.prefix(x, order, 85)[0] for x in sets]), return_counts=True)[1].max()

    assert longest(ngram_join._ordered(*nothing)) > ngram_join.SHORT_LIST
    order = ngram_join._common_order(nodes.repartition(50), 85, ngram_join._first_shingles(nodes, 85))
    assert longest(order) <= ngram_join.SHORT_LIST
    own = ngram_join.shingle_hashes(f"{texts[4]} copy".encode(), 4)
    assert order.shape[1] <= 57 and not np.isin(own, order[0]).any()  # equal texts are one node, their shingles are not frequent
    linked = {r.node: r.component for r in ngram_join.similar_sets(nodes, 85).collect()}
    assert len(linked) == 6 and len(set(linked.values())) == 3


def test_bucket_bits_follow_the_size_of_the_table():
    assert [ngram_join._bucket_bits(n) for n in (0, 10**6, 10**9, 2 * 10**9, 10**10, 10**14)] == [12, 12, 12, 13, 16, 18]
