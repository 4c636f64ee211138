"""Suffix dedup, packing, mixing, quality, HTML, chat and rollups against brute force."""
import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import no_documents, odd_documents, words
from pyspark.sql import functions as F

from millwright.llm import chat_format, html_extract, mixing, packing, pu_quality, suffix_dedup, token_rollups
from millwright.session import scratch_path

SF = "/root/testdata/sf0.001"


def brute_repeats(rows, length=50):
    first, out = {}, []
    for d, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i:i + length], d)
    for d, text in rows:
        b = (text or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < d:
                covered[i:i + length] = b"\1" * length
        spans = [i for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1])]
        kept = bytes(c for c, m in zip(b, covered) if not m)
        out.append((d, len(b), sum(covered), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(cut):
    rows = cut.select("doc_id", "n_bytes", "starts", "ends", "kept").collect()
    return sorted((r["doc_id"], r["n_bytes"], sum(b - a for a, b in zip(r["starts"], r["ends"])), len(r["starts"]),
                   hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows if r["doc_id"] is not None)


def test_repeats_of_odd_documents(spark):
    docs = odd_documents(spark).withColumn("rid", F.lit("x")).withColumn("kept", F.lit(0))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    cut = suffix_dedup.remove_repeats(docs)
    assert digest(cut) == brute_repeats(rows)
    assert [r["n_bytes"] for r in cut.filter("doc_id is null").collect()] == [3]
    assert suffix_dedup.remove_repeats(no_documents(spark)).count() == 0


def test_repeats_of_overlapping_passages(spark, monkeypatch):
    """Passages cut at every offset, inside one batch and across batches, with ties of q-grams."""
    monkeypatch.setattr(suffix_dedup, "BATCH_ANCHORS", 60)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 900)
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("abcdeé "), n))
    source = letters(900)
    rows = [(5, source), (6, source), (7, "ab" * 200), (8, "ab" * 120), (3, letters(80) + source[100:149] + letters(80))]
    for i in range(60):
        a, n = int(rng.integers(0, 800)), int(rng.integers(20, 120))
        rows.append((100 - i, letters(40) + source[a:a + n] + letters(30) + source[a + 7:a + 7 + n // 2]))
    rows += [(8, "another text under the same id " + source[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(suffix_dedup.remove_repeats(df)) == brute_repeats(rows)


def test_string_buckets_are_exact():
    data = np.frombuffer(b"abracadabra" * 9 + b"xyz" * 30, np.uint8)
    at = np.array([0, 60, 99, 150, len(data)])
    position, number = suffix_dedup.string_buckets(data, at, 20)
    strings = [bytes(data[p:p + 20]) for p in position]
    assert sorted(position) == [p for a, b in zip(at[:-1], at[1:]) for p in range(a, b - 19)]
    assert len(set(zip(strings, number))) == len(set(strings)) == len(set(number))


def test_documents_without_repeats_keep_their_columns(spark):
    docs = odd_documents(spark).withColumn("starts", F.lit("clash"))
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] is None and got[1]["text"] == "" and got[3]["text"] == "one"
    assert 40 not in got and got[10]["n_chars"] == len(got[10]["text"])


def test_ids_equal_the_tokenizer_and_pieces_fill_sequences(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_documents(spark)).withColumn("length", F.lit("clash"))
    size = 512
    got = packing.pack_documents(docs, path, size).collect()
    t = Tokenizer.from_file(path)
    expected = Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        for a in range(0, len(ids), size):
            expected[(r["doc_id"], a, tuple(ids[a:a + size]), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"]), r["doc_tokens"]) for r in got) == expected
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"]) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and {r["sequence_tokens"] for r in rows} == {at}
        assert {r["padded_length"] for r in rows} == {at if at & (at - 1) == 0 else size}
    tokens = sum(r["length"] for r in got)
    assert len(sequences) <= tokens / size * 1.03 + 2
    assert packing.pack_documents(no_documents(spark), path).count() == 0


@pytest.mark.parametrize("histogram", [{}, {3: 1000}, {512: 7}, {1: 5, 511: 5}, {200: 10, 100: 3, 57: 100, 500: 9, 1: 1}])
def test_patterns_use_up_the_histogram(histogram):
    patterns = packing.shortest_pack_first(dict(histogram), 512)
    used = Counter()
    for count, pattern in patterns:
        assert sum(k * m for k, m in pattern) <= 512
        for k, m in pattern:
            used[k] += count * m
    assert used == Counter(histogram)
    assert sum(c for c, _ in patterns) <= sum(k * n for k, n in histogram.items()) / 512 * 1.2 + 2


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    rows = mixing.mix_sources(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len(words(r["text"]))) for r in docs.collect())
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by_source.values()) - total) < 1e-6
    order = sorted((s for s in by_source if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    level = max(v[0]["target"] / weight[s] for s, v in by_source.items() if v[0]["target"] < 3 * v[0]["source_size"] - 1e-9)
    for s, v in by_source.items():
        size, target = sum(r["size"] for r in v), v[0]["target"]
        assert v[0]["source_size"] == size
        assert abs(target - min(3 * size, level * weight[s])) < 1e-6
        assert abs(sum(r["taken"] for r in v) - target) <= max(r["size"] for r in v)
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in v)
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(no_documents(spark)).count() == 0


def test_rows_under_one_id_get_copies_of_their_own(spark):
    rows = [(None, f"w{i} two three", "en", "a", 3) for i in range(9)] + [(None, "same same same", "en", "a", 3)] * 4
    rows += [(7, f"x{i} y z", "en", "b", 3) for i in range(11)] + [(i, "one two three", "en", "c", 3) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = Counter()
    for r in mixing.mix_sources(docs).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = mixing.mixed_documents(docs).collect()
    assert Counter((r["doc_id"], r["source"], 3) for r in out) == +plan
    per_row = Counter(r["text"] for r in out if r["text"] not in ("same same same", "one two three"))
    assert all(n <= 3 for n in per_row.values())
    whole = {r["source"]: r["whole"] for r in mixing.mix_sources(docs).collect()}
    assert all(per_row[f"w{i} two three"] >= whole["a"] for i in range(9)) and all(per_row[f"x{i} y z"] >= whole["b"] for i in range(11))
    again = mixing.mixed_documents(docs.repartition(5)).collect()
    assert Counter(r["text"] for r in again) == Counter(r["text"] for r in out)


def test_quality_model_separates_prose_from_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = pu_quality.train_quality(docs, labels)
    scored = pu_quality.score_quality(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(scored) > 40
    right = [r["predicted"] == r["quality"] for r in scored]
    assert np.mean(right) > 0.93
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert 0.5 < model.prior < 0.99


def test_quality_of_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in (5, 6, 7, 10)], "doc_id long, quality int, toxic int")
    model = pu_quality.train_quality(docs, labels)
    rows = pu_quality.score_quality(docs, model, keep=("doc_id", "n_chars")).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    one = {r["score"] for r in rows if r["doc_id"] in (0, 1)}
    assert len(one) == 1
    clash = docs.withColumn("score", F.lit("x"))
    assert pu_quality.good_documents(clash, model).columns == clash.columns
    none = pu_quality.train_quality(no_documents(spark), labels.limit(0))
    assert pu_quality.score_quality(no_documents(spark), none).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = ["Prose, of a kind.\nTwo lines.", None, "", "A!! B!! C!!", "x"]
    whole = pu_quality.text_features(pa.array(texts))
    for i, t in enumerate(texts):
        np.testing.assert_allclose(pu_quality.text_features(pa.array([t], pa.string()))[0], whole[i], atol=1e-6)


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One &amp; two<br>more</p><p>Short.</p></article><footer>&copy; me</footer></body></html>",
     "Title\nOne & two more\nShort."),
    ("<article><p>Kept <script>var a='</p>'</script>text<style>p{}</style></p><aside>side</aside><div class='ad box'>Buy <div>now</div></div><p>End</p>"
     "<section id=comments><p>first!</p></section></article>", "Kept text\nEnd"),
    ("<div id=sidebar><p>Side text that is rather long, to be sure.</p></div><div class=content><p>A long paragraph of main text, with commas.</p>"
     "<p>And another one.</p></div><div class='comments'>Reader says hello</div>", "A long paragraph of main text, with commas.\nAnd another one."),
    ("<nav><ul><li>never closed<article><p>Body &lt;b&gt; &eacute;&nbsp;x</p>", "Body <b> é x"),
    ("plain text only", "plain text only"),
    ("<div class=page><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div class=text><p>" + "Long text here. " * 9 + "</p><div class=ad>Buy</div><p>Short end.</p>"
     "</div><div class=foot><p>Imprint</p></div></div>", ("Long text here. " * 9).strip() + "\nShort end."),
    ("", ""), (None, ""), ("<script>only()</script>", ""), ("<form><input name=q>Search</form>", ""),
    ("<article><p>a<!-- <p>comment</p> -->b</p><p>  c \n\t d </p></article>", "ab\nc d"),
]


def test_main_text_of_pages(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", h, 1) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(df).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text)
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_main_text_keeps_every_paragraph_of_the_given_pages(spark):
    import html
    import re
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split("</?p>|</?h1>", article)]
        assert html_extract.main_text(r["html"]) == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("page", [
    "<script>for(var i=0;i<n;i++){f(i)}</script><article><p>Body.</p></article><script>g()</script>",
    "<head><SCRIPT>if(a<b&&c)x='<!--'</SCRIPT ><style>a<b{}</style></head><article><p>Body.</p></article>",
    "<nav><script>s='</nav>';i<n</script>Menu</nav><article><p>Body.</p></article>",
    "<head><title>a <b</title><body><p>Body.</p></body>",
    "<article><p>Body.</p></article><script>for(i=0;i<n;i++)s='<p>lost</p>'",
    "<article><textarea><p>typed</textarea><noscript><img src=x></noscript><p>Body.</p></article>",
])
def test_scripts_are_passed_over_as_characters(page):
    assert html_extract.main_text(page) == "Body."


BODY = "".join(f"<p>Paragraph {i} of the body, {'with a few more words, ' * 6}and an end.</p>" for i in range(6))
TEXT = html_extract.main_text(BODY)


@pytest.mark.parametrize("page", [
    f"<div class=content>{BODY}</div><div class=related><article><p>A teaser.</p></article><article><p>One more.</p></article></div>",
    f"<div class=content>{BODY}</div><div><article><p>Nice text, says a reader.</p></article><article><p>Thanks.</p></article></div>",
    f"<article>{BODY}</article><div class=comments><article><p>{'A reader says so. ' * 30}</p></article></div>",
    f"<article>{BODY}</article><div><article><p>First!</p></article><article><p>Second!</p></article></div>",
    f"<main><div>{BODY}</div></main><footer><article><p>About us</p></article></footer>",
    f"<nav><ul><li>never closed<main>{BODY}</main>",
    f"<article>{BODY}<nav><nav>a</nav>never closed</article>",
    f"<ul><li class=ad>Buy<li class=ad>More</ul><article><p class=ad>Buy this{BODY}</article>",
])
def test_landmarks_in_furniture_are_not_the_main_text(page):
    assert html_extract.main_text(page) == TEXT and TEXT.count("\n") == 5


@pytest.mark.parametrize("page, text", [
    (f"<article><div class='article-header'><h1>Title</h1></div>{BODY}</article>", "Title\n" + TEXT),
    (f"<div class='elementor-widget elementor-widget-text-editor'>{BODY}</div><div class=widget><p>Tags</p></div>", TEXT),
    (f"<article><div class=header><h2>Title</h2></div><div class='elementor-widget elementor-widget-heading'><h2>Sub</h2></div>{BODY}</article>", "Title\nSub\n" + TEXT),
    (f"<div id=skip>{BODY}</div>", TEXT),
    (f"<div class=related><div class='search rail'>{BODY}<div class=share>Share this</div></div></div>", TEXT),
    (f"<article><p>Start of it.</p><div class=notice>{BODY}</div></article>", "Start of it.\n" + TEXT),
    (f"<article>{BODY}<div class=social>Follow us<div class=ad>{'Buy this now. ' * 30}</div></div></article>", TEXT),
    (f"<div class=content>{BODY}</div><div id=comments><p>{'A reader says so. ' * 90}</p></div>", TEXT),
    (f"<div class='post comments'>{BODY}</div>", TEXT),
    (f"<article>{BODY}</article><div class=post-comments>{BODY}</div>", TEXT),
])
def test_names_of_classes_are_a_hint_only(page, text):
    assert html_extract.main_text(page) == text


LINKS = "".join(f"<li><a href=/{i}>Another story, number {i}</a></li>" for i in range(4))


@pytest.mark.parametrize("page, text", [
    (f"<article><h1><a href=/me>Title</a></h1>{BODY}<ul>{LINKS}</ul></article>", "Title\n" + TEXT),
    (f"<main><ul>{LINKS}</ul>{BODY}<p><a href=/f>Facebook</a> <a href=/m>Mail</a></p>{BODY}</main>", TEXT + "\n" + TEXT),
    (f"<article>{BODY}<ul>{LINKS}</ul>{BODY}</article>", TEXT + "\n" + TEXT),
    (f"<article><a name=top>{BODY}<p>See <a href=/x>this</a>.</p><p><a href=/y>open link<p>The end.</p></article>", TEXT + "\nSee this.\nopen link\nThe end."),
    (f"<article><p>One.</p><p><a href=/x>A linked line.</a></p><p>Two.</p></article>", "One.\nA linked line.\nTwo."),
    (f"<article><p><a href=/x>All of it is a link.</a></p></article>", "All of it is a link."),
])
def test_link_share_counts_on_marked_pages_too(page, text):
    assert html_extract.main_text(page) == text


SHORT = "<p>Yes.</p><p>No.</p><ul><li>One thing</li></ul>"
SAID = "Yes.\nNo.\nOne thing"


@pytest.mark.parametrize("page, text", [
    (f"<div class=post><div>{BODY}</div><div class=ad>Buy</div><div>{SHORT}</div></div>", TEXT + "\n" + SAID),
    (f"<section>{SHORT}</section><form>Search</form><section>{BODY}</section><nav>Menu</nav><section>{SHORT}</section>", SAID + "\n" + TEXT + "\n" + SAID),
    (f"<body><nav>Menu</nav><div class='part a'>{BODY}</div><form>Mail</form><div class='part b'>{SHORT}</div></body>", TEXT + "\n" + SAID),
    (f"<div class=x><div class=top>{BODY}</div><aside>Side</aside><section id=end>{SHORT}</section></div>", TEXT + "\n" + SAID),
    (f"<div class=x><div class=top>{BODY}</div><form>Mail</form><div class=mid>{SHORT}</div><form>Mail</form><div class=low>{BODY}</div></div>",
     TEXT + "\n" + SAID + "\n" + TEXT),
    (f"<div class=post><div><p>{'A very long paragraph. ' * 400}</p></div><form>Mail</form><div>{BODY}</div></div>",
     ("A very long paragraph. " * 400).strip() + "\n" + TEXT),
    (f"<div class=page><ul>{LINKS}</ul><div class=text>{BODY}</div><form>Mail</form><div class=imprint><p>Imprint</p></div></div>", TEXT),
])
def test_short_parts_beside_long_ones_stay(page, text):
    assert html_extract.main_text(page) == text


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_preferences_share_the_longest_prefix(spark):
    pairs = spark.createDataFrame([
        (1, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "good")], [("user", "a"), ("assistant", "b"), ("user", "x"), ("assistant", "bad!")]),
        (2, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")]),
        (3, [("user", "a")], [("system", "a"), ("assistant", "z")]),
        (4, [("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "a"), ("assistant", "b")]),
        (5, [], [("user", "a")]), (6, None, [("user", "a")]),
    ], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumn("prompt", F.lit("clash"))
    got = {r["pair_id"]: r for r in chat_format.format_preferences(pairs).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert [got[i]["prompt_turns"] for i in (1, 2, 3, 4)] == [2, 1, 0, 1]
    assert got[1]["prompt"] == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"
    for r in got.values():
        for side in ("chosen", "rejected"):
            for s in r[f"{side}_spans"]:
                assert r[side][:s["start"]].endswith("<|assistant|>\n") and r[side][s["end"]:].startswith("<|end|>\n")
    assert [got[1]["rejected"][s["start"]:s["end"]] for s in got[1]["rejected_spans"]] == ["bad!"]
    assert got[3]["chosen_spans"] == []


def test_conversations_with_odd_turns(spark):
    rows = [(1, 1, "assistant", "late"), (1, 0, "user", "early"), (1, 0, "user", "early"), (2, 0, None, None), (2, None, "user", "x"),
            (None, 0, "user", "lost"), (3, 0, "assistant", None), (4, 0, "user", "no reply"), (5, 0, "user", "u"), (5, 0, "assistant", "a"),
            (5, 1, "assistant", "b" * 5000)]
    conversations = chat_format.conversation_turns(turns(spark, rows).withColumn("turns", F.lit(0)))
    pairs = chat_format.stale_reply_pairs(conversations)
    got = {r["pair_id"]: r for r in chat_format.format_preferences(pairs).collect()}
    assert sorted(got) == [1, 3, 5]
    assert got[1]["prompt"] == "<|user|>\nearly<|end|>\n" and got[1]["rejected"] == "<|assistant|>\n<|end|>\n"
    assert got[5]["prompt_turns"] == 2 and got[5]["rejected"] == "<|assistant|>\na<|end|>\n" and len(got[5]["chosen"]) > 5000
    plan = chat_format.format_preferences(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat_format.format_preferences(chat_format.stale_reply_pairs(chat_format.conversation_turns(turns(spark, [])))).count() == 0


def test_rollups_follow_the_deltas_and_batches_apply_once(spark):
    rollup = token_rollups.TokenRollup(spark, scratch_path(spark, "rollup"))
    schema = "source string, lang string, tokenizer_version string, old_tokens long, new_tokens long"
    changes = spark.createDataFrame([("a", "en", "v", None, 5), ("a", "en", "v", None, 7), (None, None, "v", None, 1), ("a", "en", "v", None, None)], schema)
    assert rollup.totals().count() == 0
    assert rollup.apply("b1", changes) and not rollup.apply("b1", changes)
    assert rollup.apply("b2", spark.createDataFrame([("a", "en", "v", 5, 9), ("a", "en", "v", 7, None)], schema))
    assert rollup.apply("b3", changes.limit(0))
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert got == {("a", "en"): (1, 9), (None, None): (1, 1)}


def test_maintained_counts_equal_a_recount(spark):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(50, "l\nl\nm", "en", "s1", 5)], odd_documents(spark).schema))
    rollup = token_rollups.TokenRollup(spark, scratch_path(spark, "rollup"))
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"])
           for r in token_rollups.maintain_token_counts(docs.withColumn("digest", F.lit(0)), path, rollup).collect()}
    again = token_rollups.maintain_token_counts(docs, path, rollup)
    assert {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in again.collect()} == got
    rows = docs.collect()
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(first.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    expected = {}
    count = {"byte_bpe_50k": token_rollups.byte_bpe(path), "words": lambda ts: [len(words(t)) for t in ts]}
    for r in rows:
        for version, f in count.items():
            n, t = expected.get((r["source"], r["lang"], version), (0, 0))
            if r["doc_id"] is None or r["doc_id"] <= first[r["text"] or ""]:
                n, t = n + 1, t + f([token_rollups.without_repeated_lines(r["text"] or "")])[0]
            expected[(r["source"], r["lang"], version)] = (n, t)
    assert got == expected


P = "A paragraph of the story that is long enough to count as the body of a page, with words and more words, so that it has above LONG characters in it."


@pytest.mark.parametrize("page, expected", [
    (f"<article><h1>News</h1><p>A short article of few words.</p></article><div id=comments><p>{P}</p><p>{P}</p></div>", "News\nA short article of few words."),
    (f"<main><h1>News</h1><p>A short article of few words.</p></main><section class=comments><article><p>{P}</p></article><article><p>{P}</p></article></section>",
     "News\nA short article of few words."),
    (f"<div><h1>News</h1><p>A short article of few words.</p></div><ul class=commentlist><li>{P}</li><li>{P}</li></ul>", "News\nA short article of few words."),
    (f"<article><p>A short article of few words.</p><div class='post-comments'><p>{P}</p><p>{P}</p></div></article>", "A short article of few words."),
    (f"<article><p>{P}</p><div class=notice><p>{P}</p><p>{P}</p></div><p>The end of it.</p></article>", f"{P}\nThe end of it."),
    (f"<div class=cookie-banner><p>{P}</p><p>{P}</p></div><article><p>A short story.</p></article>", "A short story."),
    (f"<article><p>{P}</p><p>See <a href=1>the first report</a>, <a href=2>the second</a>, <a href=3>the third</a>.</p><p>{P}</p></article>",
     f"{P}\nSee the first report, the second, the third.\n{P}"),
    (f"<article><p>{P}</p><p>Share: <a href=1>Here and there</a> <a href=2>Elsewhere</a></p><p>{P}</p></article>", f"{P}\n{P}"),
    (f"<article><p>{P}</p><p>Tick <input type=checkbox> here.</p><p>Word <span hidden>x</span> more.</p><p>Press <button>Go</button> now.</p></article>",
     f"{P}\nTick here.\nWord more.\nPress now."),
])
def test_comments_notices_linked_sentences_and_inline_controls(page, expected):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == expected


def test_quality_when_nearly_all_documents_are_labelled(spark):
    """The unlabelled sample comes from all training rows, so junk is still told from good text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    marked = labels.select("doc_id", "quality")
    every = marked.unionByName(docs.select("doc_id").join(marked, "doc_id", "left_anti").selectExpr("doc_id", "0 AS quality"))
    model = pu_quality.train_quality(docs, every)
    rows = pu_quality.score_quality(docs, model).join(marked, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > np.mean(bad) + 0.3


def test_gradient_steps_lower_the_risk():
    """The fitted weights have a lower non-negative risk than their neighbours along every sampled direction."""
    rng = np.random.default_rng(4)
    p = rng.normal(0.4, 1.0, (900, 3)).astype(np.float32)
    u = np.concatenate([rng.normal(0.4, 1.0, (600, 3)), rng.normal(-0.4, 1.0, (1400, 3))]).astype(np.float32)

    def risk(w, b):
        pos, neg = np.logaddexp(0, -(p @ w + b)).mean(), np.logaddexp(0, u @ w + b).mean() - 0.3 * np.logaddexp(0, p @ w + b).mean()
        return 0.3 * pos + max(0.0, neg) + 0.5 * 1e-3 * float(w @ w)

    w, b = pu_quality._minimise(p, u, 0.3, 1500, 0.02, 1e-3)
    for _ in range(40):
        d = rng.normal(size=4)
        d /= np.linalg.norm(d)
        assert risk(w, b) <= risk(w + 0.2 * d[:3], b + 0.2 * d[3]) + 1e-4
