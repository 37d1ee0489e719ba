"""Encoding, packing, main text, archives, quality rules and the classifier against plain versions."""

import gzip
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memloom.llm import bpe, html_text, ordinal_quality, packing, quality_rules, warc
from memloom.llm import queries as q
from tests.compare import compare

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "Thé lång «text» of wörds, it's 12,345 times 'repeated'…  \n\t" * 60_000
ODD = [None, "", " ", "\n\n", "a", "don't stop 'til", "'s 's", "  x\n\n y  ", "a b c　d\u0085e", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n", "日本語テキスト", "é" * 50, "👩‍👩‍👧 zwj", "\x00\x01", "á", "1234567890", "!!!'s???"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, x, i) for i, x in enumerate([*ODD, LONG, LONG, *ODD])]
    return spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)


class TestEncoding:
    plain = Tokenizer.from_file(PATH)
    ours = bpe.ForcedBoundaryBpe(PATH)

    def encode(self, texts):
        import pyarrow as pa

        out = []
        for row, end, ids, at in self.ours.encode(pa.array(texts, pa.string())):
            out += [ids[at[i] : at[i + 1]].tolist() for i in range(end - row)]
        return out

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'`stredmlv.,!<|>é   \u0085　日1"), st.characters(exclude_categories=["Cs"]))), max_size=6))
    def test_ids_are_the_library_s(self, texts):
        got = self.encode(texts)
        assert got == [x.ids for x in self.plain.encode_batch(texts, add_special_tokens=False)]
        for text, ids in zip(texts, got, strict=True):
            assert self.ours.decode(np.array(ids, np.uint32)).decode() == self.plain.decode(ids, skip_special_tokens=False)

    def test_long_and_odd_texts(self, spark, texts):
        got = {r.doc_id: r for r in bpe.decode(bpe.encode(texts, PATH), PATH).collect()}
        for r in texts.collect():
            text = r.text or ""
            want = self.plain.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == want
            assert got[r.doc_id].n_tokens == len(want)
            assert got[r.doc_id].decoded == text

    def test_bytes_that_are_no_text_decode_to_replacements(self):
        half = self.plain.encode("é", add_special_tokens=False).ids  # one token; take a lone byte instead
        lone = [i for i, b in enumerate(self.ours.token_bytes) if b == b"\xc3"]
        assert self.ours.decode(np.array(lone + half, np.uint32)).decode() == self.plain.decode(lone + half, skip_special_tokens=False)

    def test_other_tokenizers_are_refused(self):
        with pytest.raises(ValueError):
            bpe.ForcedBoundaryBpe(public_tokenizers.path("word_bpe_49k.json"))

    def test_empty_table(self, spark, texts):
        assert bpe.encode(texts.where("doc_id < 0"), PATH).count() == 0


class TestPacking:
    def check(self, docs, got, capacity=1024):
        plain = Tokenizer.from_file(PATH)
        wanted = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
        by_doc, by_sequence = {}, {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
        assert by_doc.keys() == wanted.keys()
        for doc, pieces in by_doc.items():
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(wanted[doc])
                at += p.length
                assert p.ids_crc32 == zlib.crc32(wanted[doc][p.start : at].tobytes())
            assert at == len(wanted[doc])
        padding = 0
        for pieces in by_sequence.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= capacity
            padding += (capacity - at) * (at & (at - 1) > 0)
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        return padding / sum(len(x) for x in wanted.values())

    def test_documents(self, spark):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert self.check(docs, q.op3_harmonic_packing(spark, SF).collect()) < 0.02

    def test_odd_texts(self, spark, texts):
        self.check(texts, packing.pack(texts, PATH).collect())

    def test_empty_table(self, spark, texts):
        assert packing.pack(texts.where("doc_id < 0"), PATH).count() == 0

    @given(st.integers(1, 10_000), st.sampled_from([16, 1000, 1024, 4096]))
    def test_pieces(self, n, capacity):
        lengths = packing.cut_lengths(n, capacity)
        assert sum(lengths) == n and min(lengths) > 0 and max(lengths) <= capacity
        assert all(capacity % x < capacity // 8 or x * (capacity // x) > 0.9 * capacity for x in lengths if x > packing.SMALLEST)


class TestMainText:
    def test_given_pages(self, spark):
        for r in q.op5_line_block_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
            article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
            blocks = [" ".join(html_text.entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", article)]
            assert r.text == "\n\n".join(x for x in blocks if x)
            assert r.n_chars == len(r.text)

    def test_boilerplate_goes_and_structure_stays(self):
        page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
        <header><h1>Site</h1></header><nav>Home</nav><div class="cookie-notice">We use cookies, a long sentence about them all.</div>
        <main><article class="post"><header><h2>A &amp; B</h2></header><p>First <b>bold
        </b>part<br>goes on.<p>Second&nbsp;one<div class="ad">Buy now</div><ul><li>x<li>y</ul><form>Name</form>
        <table><tr><td>1<td>2</table><aside>more</aside><footer>by me</footer></article>
        <section id="comments"><article>nice text!</article></section></main><footer>(c)</footer><script>if (a<b) "</p>"</script></body>"""
        assert html_text.main_text(page) == "A & B\n\nFirst bold part goes on.\n\nSecond one\n\nx\n\ny\n\n1 2"

    def test_pages_without_article_markup(self):
        body = "".join(f"<p>{'word ' * 30}{i}.</p>" for i in range(4))
        page = f'<body><div class="menu"><a href="/">Home</a></div><div id="content"><h1>Title</h1>{body}</div><div id="footer">end of it</div></body>'
        assert html_text.main_text(page).startswith("Title\n\nword") and "end of it" not in html_text.main_text(page)
        assert html_text.main_text("just a line") == "just a line"

    @pytest.mark.parametrize("names", ['class="wrapper has-sidebar"', 'class="post share-enabled"', 'id="content" class="no-comments"', 'class="hasSidebar"', 'class="sidebar-wrapper"', 'class="widget"'])
    @pytest.mark.parametrize("kind", ["article", "main", "div"])
    def test_names_of_wrappers_are_evidence_only(self, names, kind):
        story = f"<{kind}><h1>Title of it</h1><p>{'word ' * 40}</p></{kind}>"
        page = f'<body><div class="menu">Home</div><div {names}>{story}<div class="ad">Buy</div></div><div class="comments"><p>nice text!</p></div></body>'
        assert html_text.main_text(page) == "Title of it\n\n" + ("word " * 40).strip()
        page = f'<body><article><p>Story.</p><div class="comments"><article>{"reader " * 40}</article><p>{"reader " * 40}</p></div></article></body>'
        assert html_text.main_text(page) == "Story."

    @pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
    def test_given_articles_through_the_windows(self, folder):
        import pyarrow.parquet as pq

        for page in pq.read_table(f"/root/testdata/{folder}/pages.parquet")["html"].to_pylist():
            blocks = [" ".join(html_text.entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", re.search(r"<article>(.*?)</article>", page, re.S)[1])]
            assert html_text.main_text(page) == "\n\n".join(x for x in blocks if x)

    def test_windows_decide_on_marked_pages_too(self):
        story = "story word " * 40
        page = f'<body><article><p>Short teaser of it.</p></article><div id="x"><p>{story}</p><p>End.</p></div></body>'
        assert html_text.main_text(page) == f"Short teaser of it.\n\n{story.strip()}\n\nEnd."
        page = f'<body><h1>The title</h1><article><p>{story}</p><div class="ad">Buy</div><p><a href="x">all link</a></p></article><div class="zz">A short notice without a name, of over sixty characters in all.</div></body>'
        assert html_text.main_text(page) == f"The title\n\n{story.strip()}\n\nall link"
        page = f'<body><div id="c"><h1>T</h1><div class="ad">Buy</div><p>{story}</p><div class="share">s</div><p>Fin.</p></div><div class="ad">x</div><div>Imprint</div></body>'
        assert html_text.main_text(page) == f"T\n\n{story.strip()}\n\nFin."
        for wrapper in ('<article><div class="entry-content has-comments">', '<div id="content" class="with-sidebar">', '<div class="layout share-enabled">'):
            assert html_text.main_text(f"<body>{wrapper}<p>{story}</p></div></article></body>") == story.strip()

    @pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 10, "<b>" * 50_000 + "</i>" * 50_000, "<p>x<b>" * 30_000, "<div><p>" * 30_000 + "<h1>" * 30_000, "<li><b>" * 40_000])
    def test_unclosed_tags_take_linear_time(self, page):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 5  # some 0.2 s; quadratic work takes minutes

    def test_odd_pages(self, spark):
        rows = [(1, None, None), (2, "u", ""), (2, "u", "<"), (3, "u", "<p"), (4, "u", "<!-- open"), (5, "u", "<script>x"), (6, "u", "<div " + "a='" * 2000), (7, "u", "<p>&#x41;&bogus;" * 30_000)]
        got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert len(got) == len(rows)
        assert {r.page_id: r.text for r in got}[7].split("\n\n") == ["A&bogus;"] * 30_000
        assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

    @settings(max_examples=200, deadline=None)
    @given(st.text(st.sampled_from("<>/pdivabr \"'=!-&;articlenx\n")))
    def test_nothing_breaks(self, page):
        html_text.main_text(page)

    def test_surge_and_dive(self):
        assert html_text.between_surge_and_dive([0, 0, 0, 50, 40, 0, 60, 0, 0, 0, 5, 0], 60) == [(3, 7)]

    def test_forms_around_the_page_and_second_parts(self):
        story, more = "This is a sentence of the story. " * 12, "And so it goes on, elsewhere. " * 6
        story, more = story.strip(), more.strip()
        for wrapper in ("form", "fieldset", "search"):
            assert html_text.main_text(f"<body><{wrapper} id=x><div><p>{story}</p></div></{wrapper}></body>") == story
            assert html_text.main_text(f"<body><{wrapper}><article><p>{story}</p></article></{wrapper}></body>") == story
        form = "<form><p>Write to us</p><label>Mail</label><input><button>Send</button></form>"
        assert html_text.main_text(f"<body><div><p>{story}</p></div>{form}</body>") == story
        assert html_text.main_text(f"<body><article><p>{story}</p>{form}<p>After.</p></article></body>") == f"{story}\n\nAfter."
        assert html_text.main_text(f'<body><article><p>{story}</p></article>{form}<div class="story"><p>{more}</p></div></body>') == f"{story}\n\n{more}"
        assert html_text.main_text(f"<body><article><p>{story}</p></article>{form}<div><p>{more[:90]}</p></div></body>") == story
        assert html_text.main_text(f"<p>Press the <button>Save</button> key. {story}</p><p><button>Share</button></p>") == f"Press the Save key. {story}"


class TestWarc:
    def test_same_as_sql(self, spark):
        assert compare(spark, q.op8_warc_normaliser, q.oracle_sql()["op8_warc_normaliser"], SF) > 0

    def test_copies_nulls_and_order(self, spark):
        long = "y" * 200
        rows = [(5, "u\r\n5", long), (3, None, long), (9, "u", long), (1, "u", None), (2, "u", ""), (None, "u", long), (7, "u", "short"), (8, "u", "short"), (3, None, long)]
        got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
        assert len(got) == len(rows)
        kinds = sorted(((r.page_id or -1), r.record_type, r.refers_to) for r in got)
        assert kinds.count((3, "response", None)) == 1 and kinds.count((3, "revisit", 3)) == 1
        assert (5, "revisit", 3) in kinds and (9, "revisit", 3) in kinds and (-1, "revisit", 3) in kinds
        assert (7, "response", None) in kinds and (8, "response", None) in kinds and (1, "response", None) in kinds
        assert all(r.payload_bytes == 200 and r.payload_digest == hashlib.sha256(long.encode()).hexdigest() for r in got if r.page_id in (3, 5, 9))

    def test_members_open_alone(self, spark, tmp_path):
        pages = spark.read.parquet(f"{SF}/pages.parquet")
        warc.archive_and_read(pages, f"file://{tmp_path}").count()
        archives = sorted((tmp_path / "warc").glob("*.warc.gz"))
        assert archives and not (tmp_path / "raw").exists()
        seen = 0
        for path in archives:
            raw = path.read_bytes()
            for line in (path.parent / f"{path.name}.idx").read_text().splitlines():
                offset, length, kind, page_id = line.split("\t")
                record = gzip.decompress(raw[int(offset) : int(offset) + int(length)])
                assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and f"X-Page-Id: {page_id}\r\n".encode() in record
                seen += 1
        assert seen == pages.count()

    def test_empty_table(self, spark):
        assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


    def test_archives_are_dealt_over_tasks(self, spark, monkeypatch):
        monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)
        tasks = []
        normalise, read_back = warc.normalise, warc.read_back
        monkeypatch.setattr(warc, "normalise", lambda plan, *at: tasks.append(plan.rdd.getNumPartitions()) or normalise(plan, *at))
        monkeypatch.setattr(warc, "read_back", lambda archives, at: tasks.append([len(x) for x in archives.rdd.glom().collect()]) or read_back(archives, at))
        pages = spark.createDataFrame([(i, "u", f"page {i % 50} " * 20) for i in range(300)], "page_id long, url string, html string").repartition(4)
        assert warc.archive_and_read(pages).count() == 300
        assert tasks[0] >= 100 and len(tasks[1]) >= 100 and max(tasks[1]) <= 4
        assert warc.tasks_of(0) == 1 and warc.tasks_of(6_000_000) == 375_000

class TestQualityRules:
    def test_same_as_sql(self, spark):
        assert compare(spark, q.op7_quality_rules, q.oracle_sql()["op7_quality_rules"], SF) > 0

    @staticmethod
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = {}
        for i in range(len(words) - 4):
            windows.setdefault(tuple(words[i : i + 5]), []).append(i)
        repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)

    def test_odd_texts(self, spark):
        random.seed(1)
        loops = [" ".join(random.choice(["a", "b", "ü"]) for _ in range(random.randint(1, 40))) for _ in range(60)]
        texts = [*ODD, *loops, "x\ny\nx\n \n \ny ", "é|# $ 1", "w " * 30_000]
        docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
        for r in quality_rules.apply_rules(docs).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == self.plain(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept in (True, False) and not (r.kept and r.base_failed)

    def test_stage_keeps_clashing_columns(self, spark):
        text = " ".join(f"the cat {i} sat" for i in range(10))
        docs = spark.createDataFrame([(1, text, 7, "k", [1]), (2, "bad", 8, "k", [2])], "doc_id long, text string, N_words int, kept string, _lines array<int>")
        left = quality_rules.kept_documents(docs)
        assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, text, 7, "k", [1])]

    def test_filters_on_the_verdict_stay_cheap(self, spark):
        docs = spark.createDataFrame([(1, "the cat " * 20)], "doc_id long, text string")
        plan = quality_rules.apply_rules(docs).where("kept").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 20_000

    def test_no_python(self, spark):
        plan = q.op7_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

    def test_empty_table(self, spark):
        assert quality_rules.apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


class TestClassifier:
    def test_held_out_accuracy(self, spark):
        folder = "/root/testdata/sf0.1"
        docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
        held = labels.where("doc_id % 3 = 0")
        got = ordinal_quality.classify(docs.join(held.select("doc_id"), "doc_id", "left_semi").unionByName(docs.join(labels.where("doc_id % 3 <> 0").select("doc_id"), "doc_id", "left_semi")), labels.where("doc_id % 3 <> 0"))
        rows = got.join(held, "doc_id").collect()
        good = [r for r in rows if r.quality == 1 and r.toxic == 0]
        toxic, poor = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0 and r.quality == 0]
        assert sum(r.kept for r in good) > 0.96 * len(good)  # from some 2,600 ratings; 99 % from 6,000
        assert sum(not r.kept for r in toxic) > 0.97 * len(toxic)
        assert sum(not r.kept for r in poor) > 0.85 * len(poor)
        assert all(0 <= r.tail_2 <= r.tail_1 <= 1 and abs(r.expected_grade - r.tail_1 - r.tail_2) < 1e-9 for r in rows)

    def test_odd_texts_and_no_ratings(self, spark, texts):
        labels = spark.createDataFrame([(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
        got = ordinal_quality.classify(texts, labels).collect()
        assert len(got) == texts.count()
        assert ordinal_quality.classify(texts.where("doc_id < 0"), labels).count() == 0

    def test_worst_rating_counts_and_the_sample_is_bounded(self, spark):
        labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
        assert {r.doc_id: r.grade for r in ordinal_quality.sample_of_ratings(labels).collect()} == {1: 1, 2: 0, 3: 2}
        assert ordinal_quality.sample_of_ratings(labels, 2).count() == 2

    def test_clashing_columns_and_repeated_rated_ids(self, spark):
        rows = [(1, "the good text", 5.0, "x", "y"), (2, "bad !!! text", 6.0, "x", "y")] + [(3, f"text {i}", 7.0, "x", "y") for i in range(200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, tail_2 double, kept string, Expected_Grade string")
        labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
        got = ordinal_quality.classify(docs, labels, carry=tuple(docs.columns))
        assert got.columns == ["doc_id", "text", "expected_grade", "tail_1", "tail_2", "kept"] and got.count() == len(rows)
        left = ordinal_quality.kept_documents(docs, labels, least=0.0)
        assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == sorted(rows)
        trained = []
        train, ordinal_quality.train = ordinal_quality.train, lambda rated, **kw: trained.extend(rated.collect()) or train(rated, **kw)
        try:
            ordinal_quality.classify(docs, labels).count()
        finally:
            ordinal_quality.train = train
        assert sorted((r.doc_id, r.text) for r in trained) == [(1, "the good text"), (2, "bad !!! text"), (3, "text 0")]

    def test_the_fit_is_a_minimum_of_the_loss(self):
        rng = np.random.default_rng(7)
        grades = np.repeat([0, 1, 2, 3], [90, 100, 110, 100])
        rows = np.repeat(np.arange(400), 2)
        features = np.concatenate([[g * 2 + rng.integers(0, 2) if rng.random() < 0.9 else rng.integers(0, 8), 8 + rng.integers(0, 4)] for g in grades])
        values = rng.uniform(0.5, 1.5, len(rows))
        use = np.isin(features, np.flatnonzero(ordinal_quality.telling(np.array([np.bincount(features[grades[rows] == k], minlength=16) for k in range(4)]), np.bincount(grades))))
        assert 100 < use.sum() <= 400  # features of all grades alike have no weight
        model = ordinal_quality.fit_ordinal(rows, features, values, grades, 4, 16, l2=0.01, steps=3000, rate=0.02)

        def loss(weights, thresholds):
            total = 0.005 * (weights**2).sum()
            for i, g in enumerate(grades):
                s = sum(v * weights[f] for f, v, u in zip(features[2 * i : 2 * i + 2], values[2 * i : 2 * i + 2], use[2 * i : 2 * i + 2], strict=True) if u)
                above = [1.0, *(1 / (1 + np.exp(t - s)) for t in thresholds), 0.0]
                total -= np.log(above[g] - above[g + 1]) / (4 * (grades == g).sum())
            return total

        w, t = model.weights.astype(float), model.thresholds
        best = loss(w, t)
        assert best < loss(0 * w, np.array([-1.1, 0, 1.1])) - 0.1
        for _ in range(20):
            for size in (1e-3, 1e-2, 0.1):
                assert loss(w + size * rng.standard_normal(16) * (w != 0), t + size * rng.standard_normal(3)) > best - 1e-6

    def test_thresholds_rise(self):
        random_ = np.random.default_rng(3)
        grades = random_.integers(0, 4, 400)
        rows = np.repeat(np.arange(400), 3)
        features = (grades[rows] * 3 + random_.integers(0, 4, 1200)).astype(np.int64)
        model = ordinal_quality.fit_ordinal(rows, features, np.ones(1200), grades, 4, 64)
        assert (np.diff(model.thresholds) > 0).all()
        expected = model.tails(np.bincount(rows, model.weights[features], minlength=400)).sum(axis=1)
        assert np.corrcoef(expected, grades)[0, 1] > 0.85
