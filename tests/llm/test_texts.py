"""Private spans, chat format, main text, quality rules, decontamination, addresses, packing and the pipeline."""

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from throngcast.llm import aliases, chat, decontaminate, host_rules, main_text, packing, private_spans
from throngcast.llm.queries import tokenizer_files

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

NOTES = [
    None, "", "no data", "mail a.b@c.de, a@b, x@y.z_w@q.rs and é me@host.example.com.",
    "ip 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5.6.7.8 or 0001.2.3.4", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 12 34",
    "call +1 (269) 555-3296 or +12 or +1234567890123456", "9" * 5000 + " +1 555 123 4567 " + "a" * 30000 + "@b.cd" + " 4111111111111111" * 300,
]


def test_private_base_spans_equal_brute_force(spark):
    rows = [(i, n, "x") for i, n in enumerate(NOTES)] + [(1, "", "x"), (None, NOTES[3], "x")]
    got = private_spans.find_private(spark.createDataFrame(rows, "signal_id long, note string, base string"), rows=2000, trees=4)
    got = got.select("signal_id", "note", private_spans.spelled(got.base).alias("base"), private_spans.spelled(got.spans).alias("spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base == brute.private(r.note)
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_trees_add_spelled_out_forms_and_leave_clean_notes(spark):
    notes = ["mail me: jane.07 (at) mail [dot] org", "call me at (269) 555-3296", "version 2.10.3 of 2024-05-06 12", "order 123456789012", "the sum of 1 234 567 is fine"]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "signal_id long, note string")
    found = private_spans.find_private(frame)
    spans = {r.signal_id: r.s for r in found.select("signal_id", private_spans.spelled(found.spans).alias("s")).collect()}
    assert spans[0].startswith("email:") and spans[1].startswith("phone:") and not spans[2] and not spans[3] and not spans[4]
    assert {r.signal_id: r.note for r in private_spans.redact(found).collect()}[1] == "call me at [phone]"
    assert private_spans.find_private(frame.where("false")).count() == 0


def test_chat_round_trip(spark):
    texts = ["", None, "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "a <", "|b", "<|next|>", "é\n\nz"]
    rows = [(c, t, role, text, "x") for c in range(3) for t, (text, role) in enumerate(zip(texts[c:] + texts[:c], ["user", "user", "assistant", "assistant", "sys\nt\\n", "assistant", None, "<|r", "user"]))]
    rows += [(7, 0, "user", "same", "x"), (7, 0, "user", "same", "x"), (None, None, None, None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    done = chat.format_conversations(frame)
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    for r in chat.read_back(done).collect():
        turns = sorted(want.pop(r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in turns]
        assert r.loss_text == "".join(text for _, role, text in turns if role == "assistant")
    assert not want
    assert chat.read_back(chat.format_conversations(frame.where("false"))).count() == 0


def page(body, title="t"):
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav>{body}<footer>&copy; x</footer></body></html>"


PAGES = [
    ("<article><h1>One &amp; two</h1><p>a  b\n c<br>d<p>next <b>bold <i>x</b></i> end<script>var t='</p>';</script> on<div class='ad box'>buy</div><ul><li>i<li>j</ul></article>", "One & two\n\na b c d\n\nnext bold x end on\n\ni\n\nj"),
    ("<div id=content><p>text <span class=\"ad\">no <span>no</span></span>goes on</p></div><div class='comments'><article>nice</article></div>", "text goes on"),
    ("<main><p title=\"a > b\">quoted</p><aside>side</aside><form><p>f</p></form><p>1 &lt; 2 &am</p></main><p>outside</p>", "quoted\n\n1 < 2 &am"),
    ("plain < text <!-- <p>gone</p> --> here", "plain < text here"),
]


def test_main_text_of_single_pages(spark):
    rows = [(i, f"http://h{i}.org/x", page(b), "x") for i, (b, _) in enumerate(PAGES)] + [(8, None, None, "x"), (9, "u", "", "x"), (9, "u", "", "x")]
    got = main_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (PAGES[r.page_id][1] if r.page_id < 8 else "")


def test_template_decides_inside_and_outside_articles(spark):
    rows = [(i, "http://h.org/x", f"<html><body><div><p>story {i} told</p></div><article><h2>Our offers</h2><p>teaser {i}</p><p>Subscribe now</p></article></body></html>") for i in range(6)]
    got = main_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"story {i} told\n\nteaser {i}" for i in range(6)}


@pytest.mark.parametrize("before, after", [
    ("<html><body class='no-sidebar'>", "</body></html>"), ("<html class='header-fixed'><body>", "</body></html>"), ("<body><div class='content with-sidebar'>", "</div></body>"),
    ("<article class='post comments-open'>", "</article>"), ("<body><svg class=i viewBox='0 0 1 1'/>", "</body>"), ("<body><p><math/></p>", "<svg><text>no</text></svg></body>")])
def test_layout_classes_and_empty_foreign_elements_lose_no_text(before, after):
    assert main_text.main_blocks(f"{before}<p>whole story</p><div class='sidebar'>side</div>{after}", set()) == ["whole story"]


@pytest.mark.parametrize("html, text", [
    ("<article><h2 class='section-header'>Title</h2><p>story</p></article>", ["Title", "story"]), ("<article><section id='discussion'><p>points</p></section></article>", ["points"]),
    ("<article><div class='article-header'><h1>Head</h1></div><p>x</p></article>", ["Head", "x"]), ("<div class='page header-fixed'><p>all of it</p></div>", ["all of it"]),
    ("<p title='a > b'>kept</p>", ["kept"]), ("<p title=\"it's > so\">kept</p>", ["kept"]), ("<p it's>one</p><p don't>two</p>", ["one", "two"]), ("<p a='open>text</p>", ["text"])])
def test_names_and_quotes_lose_no_text(html, text):
    assert main_text.main_blocks(f"<html><body>{html}</body></html>", set()) == text


def test_deep_and_long_pages():
    deep = "<div>" * 100_000 + "<p>down here</p>" + "</div>" * 100_000 + "<p>and after</p>"
    assert main_text.main_blocks(deep, set()) == ["down here", "and after"]
    odd = "<x-y>" * 50_000 + "<section>one</section>" * 1000
    assert main_text.main_blocks(odd, set()) == ["one"] * 1000
    long = "<article>" + "<p>" + "word " * 400_000 + "</p></article>"
    assert main_text.main_blocks(long, set()) == [("word " * 400_000).strip()]
    assert main_text.main_blocks("<p " + "a='b' " * 200_000, set()) == main_text.main_blocks("<p " + "a='b' " * 200_000, set())


def test_template_text_of_a_host_is_left_out(spark):
    rows = [(i, "http://h.org/x", f"<html><body><div><p>Welcome to our site</p><p>story {i} told</p><p>All rights here</p></div></body></html>") for i in range(6)]
    rows += [(10 + i, "http://few.org/", "<html><body><div><p>Welcome to our site</p></div></body></html>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.extract_main_text(pages).collect()}
    assert [got[i] for i in range(6)] == [f"story {i} told" for i in range(6)]
    assert got[10] == "Welcome to our site"                 # copies of one page show no template
    assert main_text.extract_main_text(pages.where("false")).count() == 0


def test_host_rules(spark):
    good = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n", good, "a b c " * 30, "x\nx\n\n \n#$ y", good + "\n" + good, "é" * 40000, "w " * 50000]
    rows = [(i, "ok", t, "x") for i, t in enumerate(texts)] + [(100 + i, "bad", "short", "x") for i in range(400)] + [(i, "ok", good, "x") for i in range(20, 50)] + [(600, "bad", good, "x"), (700, None, good, "x"), (700, None, good, "x")]
    got = host_rules.judge(spark.createDataFrame(rows, "incident_id long, map_id string, description string, n_words string")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, lines, repeated = brute.stats(r.description)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
    kept = {r.incident_id: r.kept for r in got}
    assert kept[3] and kept[700] and not kept[600] and not kept[0]
    assert host_rules.judge(spark.createDataFrame([], "incident_id long, map_id string, description string")).count() == 0


def test_map_verdicts_equal_brute_force(spark):
    """A map of mostly junk goes, by whichever rule; a small unlucky one, and one like all others, stays."""
    maps = {"junk": (60, 42), "unlucky": (3, 3), **{f"ok{i}": (50 + i, i % 5) for i in range(20)}}
    rows = [(m, rule, n, f if rule == "symbols" else n // 20) for m, (n, f) in maps.items() for rule in ("symbols", "few_words")]
    got = {(r.map_id, r.rule): r for r in host_rules.map_verdicts(spark.createDataFrame(rows, "map_id string, rule string, n long, failed long")).collect()}
    for rule in ("symbols", "few_words"):
        own = [(m, n, f) for m, r, n, f in rows if r == rule]
        p = np.array([f / n for _, n, f in own])
        m, v = p.mean(), p.var()
        s = max(1.0, m * (1 - m) / v - 1)
        for name, n, f in own:
            rate = (f + m * s) / (n + s)
            low = rate - 2 * (rate * (1 - rate) / (n + s + 1)) ** 0.5
            r = got[name, rule]
            assert abs(r.rate - rate) < 1e-9 and abs(r.low - low) < 1e-9 and r.rejected == (low > max(0.5, m))
    assert [k for k, r in got.items() if r.rejected] == [("junk", "symbols")]
    alike = host_rules.map_verdicts(spark.createDataFrame([(f"m{i}", "symbols", 100, 90) for i in range(5)], "map_id string, rule string, n long, failed long"))
    assert not alike.where("rejected").count()
    good = " ".join(f"w{i}" for i in range(60))
    texts = [("loud", good + " #$%" * 9)] * 40 + [("loud", good)] * 4 + [(f"ok{i % 6}", good) for i in range(90)]
    judged = host_rules.judge(spark.createDataFrame([(i, m, t) for i, (m, t) in enumerate(texts)], "incident_id long, map_id string, description string"))
    assert {r.map_id for r in judged.where("NOT kept").collect()} == {"loud"} and judged.where("NOT kept").count() == 44 and not judged.where("base_failed").count()


def test_overlapping_candidates_are_chosen_in_order(spark):
    """A > B > C where only neighbours overlap: B goes for A, so nothing that stays covers C."""
    rows = [([(-0.9, 0, -10, 0), (-0.8, 8, -20, 1), (-0.7, 18, -30, 2)],), ([(-0.7, 5, -9, 2), (-0.7, 5, -12, 3)],), ([],)]
    found = spark.createDataFrame(rows, "c array<struct<worse:double,begin:int,back:int,kind:int>>").select(private_spans.disjoint(F.col("c")).alias("d")).collect()
    assert [[(x.begin, x.back) for x in r.d] for r in found] == [[(0, -10), (18, -30)], [(5, -12)], []]


def test_decontamination_equals_brute_force(spark):
    words = [f"t{i}" for i in range(400)]
    items = [(1, " ".join(words[:25])), (2, "Only, three WORDS"), (3, " ".join(words[5:15])), (4, None), (5, "?!"), (2, "Only, three WORDS"), (None, "zz yy")]
    rows = [(1, " ".join(words[3:14])), (2, " ".join(words[3:12])), (3, "so only three-words. here"), (4, None), (5, ""), (6, " ".join(words[:25]).upper() + " x " + " ".join(words[10:30])),
            (7, "zz yy"), (7, "zz yy"), (8, " ".join(words) * 50), (9, "é" * 30)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "incident_id long, description string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute.contamination(r.description, items)
        assert (r.n_words, r.n_hit, set(r.item_ids), r.contaminated) == (n, hit, found - {None}, hit > 0)
    clean = {r.incident_id for r in decontaminate.clean_only(docs, bench).collect()}
    assert clean == {i for i, t in rows if not brute.contamination(t, items)[1]}
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0
    assert not decontaminate.contamination(docs, bench.where("false")).where("contaminated").count()


def test_winnowing_sees_every_shared_span():
    rng = np.random.default_rng(2)
    for _ in range(200):
        span = rng.integers(0, 6, 10)
        a, b = (np.concatenate((rng.integers(0, 6, rng.integers(0, 9)), span, rng.integers(0, 6, rng.integers(0, 9)))) for _ in range(2))
        kept = [set(g[decontaminate.winnowed(g)]) for g in (decontaminate.gram_hashes(x.astype(np.uint64), decontaminate.GRAM) for x in (a, b))]
        assert kept[0] & kept[1]


def test_urls_and_aliases(spark):
    urls = ["http://a.net/x", "https://B.example.org/es/1", "http://c.net/y#top", "http://d.com/fr/1", "http://e.net/", None, "no scheme", "http://f.com/de/2?q", "http://g.net/z", "http://org", "http://c.net/y", ""]
    cameras = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "camera_id long, image_url string, host string")
    links = spark.createDataFrame([("http://a.net/x", "http://hop.net/1"), ("http://hop.net/1", "https://B.example.org/es/1"), ("http://c.net/y", "http://a.net/x#f"), ("http://g.net/z", "http://f.com/de/2?q"),
                                   ("http://f.com/de/2?q", "http://d.com/fr/1"), (None, "http://e.net/"), ("http://e.net/", "http://e.net/")], "source_url string, target_url string")
    got = {r.camera_id: r for r in aliases.judge_urls(cameras, links).collect()}
    assert len(got) == len(urls)
    assert [got[i].verdict for i in range(12)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block", "allow", "allow", "block", "allow"]
    assert (got[1].host, got[1].path, got[1].rule) == ("b.example.org", "/es/1", "example.org/es/") and got[5].host == "" and got[9].rule is None
    alone = aliases.judge_urls(cameras, links.where("false")).collect()
    assert {r.camera_id for r in alone if r.verdict == "block"} == {1, 7}
    assert aliases.judge_urls(cameras.where("false"), links).count() == 0


def test_links_from_markup(spark):
    pages = spark.createDataFrame([("http://a.net/d/x", '<LINK href="/y?a=1&amp;b=2" rel="canonical"><link rel=stylesheet href=s.css>'), ("http://a.net/d/x", "<meta http-equiv=refresh content='0; url=z'>"),
                                   ("http://a.net", "<link rel=canonical href=//b.org/q>"), (None, "<link rel=canonical href=/y>"), ("http://n.net/", None)], "url string, html string")
    assert {tuple(r) for r in aliases.page_links(pages).collect()} == {("http://a.net/d/x", "http://a.net/y?a=1&b=2"), ("http://a.net/d/x", "http://a.net/d/z"), ("http://a.net", "http://b.org/q")}


def test_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "one", "one", "word " * 1023, "word " * 1024, "long text, " * 3000, "<|endoftext|> é  \n 12", *(f"text {i} " * (i % 90) for i in range(120))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "incident_id long, description string, length string")
    got = packing.pack(packing.tokenized_pieces(docs, *tokenizer_files())).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.incident_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in pieces for x in r.ids] == ids and all(r.length == 1024 for r in pieces[1:])
        assert [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces] == [r.ids_crc32 for r in pieces]
    for places in by_sequence.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert ends[:-1] == [a for a, _ in sorted(places)] and ends[-1] <= 1024
    assert packing.pack(packing.tokenized_pieces(docs.where("false"), *tokenizer_files())).count() == 0


def test_patterns_use_every_piece_and_few_sequences():
    rng = np.random.default_rng(0)
    for size in (10, 5000, 400_000):
        lengths = np.clip(rng.lognormal(5.8, 0.9, size).astype(int), 1, 1024)
        histogram = np.bincount(lengths, minlength=1025)
        plan = packing.fit_patterns(histogram)
        used = np.zeros(1025, int)
        for pattern, times in plan:
            assert sum(pattern) <= 1024
            np.add.at(used, list(pattern), times)
        assert (used == histogram).all()
        assert sum(n for _, n in plan) <= -(-lengths.sum() // 1024) * 1.01 + 2


def near_firsts(ids, texts):
    """The smallest id of every group of texts linked by five-word shingles at a Jaccard similarity of 0.8."""
    sets = {i: brute.shingles(texts[i], 5) for i in ids}
    linked = {i: [j for j in ids if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in ids}
    low = {i: i for i in ids}
    while True:
        lower = {i: min(low[j] for j in linked[i]) for i in ids}
        if lower == low:
            return set(low.values())
        low = lower


HARD = "word " * 30 + "blank" + " " * 2_000_000 + "run " + "and some more words that differ from all the others " * 30


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    """NULLs, blank and very long texts, ties, repeated rows and columns named like the operators' own."""
    spark.createDataFrame([("b0", "a benchmark passage of more than ten words that one text repeats in full"), (None, None), ("b1", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    say = lambda n, tag: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(0, say(80, "a"), "s0"), (0, say(80, "a"), "s0"), (1, say(80, "a") + " z", "s1"), (2, None, None), (3, "", "s2"), (4, " \n\t", None), (None, say(90, "b"), None), (5, HARD, "s3"),
            (6, say(60, "c") + " a benchmark passage of more than ten words that one text repeats in full " + say(60, "d"), "s4"), (7, "word " * 400_000, "s5"), (8, say(70, "e"), "s0")]
    schema = "doc_id long, text string, source string, n_chars long, fingerprint long, kept string, n_words int, n_lines int, component_id string, n_removed int, _others int"
    docs = spark.createDataFrame([(*r, -1, 777, "mine", 5, 6, "c", 7, 8) for r in rows], schema)
    texts = {r[0]: r[1] for r in rows}
    left = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    for name in ("quality_rules", "line_dedup", "near_dedup", "decontamination"):
        assert left[name].columns == docs.columns
        left[name] = left[name].collect()
        assert all((r.fingerprint, r.kept, r.n_words, r.n_lines, r.component_id, r.n_removed, r._others) == (777, "mine", 5, 6, "c", 7, 8) for r in left[name]), name
    ids = lambda name: sorted(str(r.doc_id) for r in left[name])
    assert ids("quality_rules") == sorted(["0", "0", "1", "None", "6", "8", *(["5"] if not brute_fails(HARD) else [])])
    assert len(left["line_dedup"]) == len(rows) and {r.doc_id: r.text for r in left["line_dedup"]} == texts
    assert ids("near_dedup") == ["0", "2", "5", "6", "7", "8", "None"]
    assert ids("decontamination") == sorted(str(r[0]) for r in rows if r[0] != 6)
    pieces = left["sequence_packing"].collect()
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total[2] == total[3] == 1 and set(total) == set(texts) and all(r.offset >= 0 for r in pieces)
    from tokenizers import Tokenizer
    assert total[5] == len(Tokenizer.from_file(tokenizer_files()[2]).encode(HARD, add_special_tokens=False).ids) + 1


def brute_fails(text):
    n, _, _, _, repeated = brute.stats(text)
    return n < 50 or 100 * repeated > 50 * n


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sequence_packing"]
    quality, lines, near, clean, packed = (f for _, f in corpus_pipeline.STAGES)

    def passes(text):
        n, _, _, _, repeated = brute.stats(text)
        return n >= 50 and 100 * repeated <= 50 * n

    want = {r["doc_id"]: r for r in rows if passes(r["text"])}
    kept = corpus_pipeline.written(quality(spark, docs, folder), "test")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want)
    left = corpus_pipeline.written(lines(spark, kept, folder), "test")
    texts = dict(zip(want, brute.without_spread_lines([(r["source"], r["text"]) for r in want.values()], 10)))
    assert {r.doc_id: r.text for r in left.collect()} == texts
    ids = sorted(texts)
    firsts = near_firsts(ids, texts)
    one = corpus_pipeline.written(near(spark, left, folder), "test")
    assert sorted(r.doc_id for r in one.collect()) == sorted(firsts)
    pure = corpus_pipeline.written(clean(spark, one, folder), "test")
    assert {r.doc_id for r in pure.collect()} == {i for i in firsts if not brute.contamination(texts[i], items)[1]}
    final = packed(spark, pure, folder).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in pure.collect()}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


@pytest.mark.parametrize("name", ["op9_site_lines", "op11_hard_negatives", "op12_vector_copies", "op13_value_codes"])
def test_queries_equal_sql(spark, name):
    from oracle import connect, differences
    from throngcast.llm.queries import QUERIES, SQL
    folder = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, folder), connect(folder), SQL[name]) is None
