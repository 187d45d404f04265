"""Operators without SQL against plain loops: pairwise terms, media columns, personal data, blocks of the language model, odd tables by value."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlake.llm import audit, hmm, jpeg, minhash, packing, pii, quality, substring
from arborlake.llm.common import documents, remainder

SF = "/root/testdata/sf0.001"
CLASHING = ("component_id", "block", "key", "hash", "text_", "n", "start", "length", "score", "_row", "w", "x")


def odd(spark):
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "three"), (4, long), (5, long + " w0"), (6, " \n\t ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(7) for c in CLASHING})


def test_margins_equal_all_pairs():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    rows = [(rng.choice(quality.SIZE, n, replace=False), rng.normal(size=n)) for n in (1, 2, 7, 12)]
    sizes = np.array([len(i) for i, _ in rows])
    found, _ = quality.margins(model, np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes)
    for (index, value), margin in zip(rows, found):
        expected = model.w0 + sum(model.w[i] * v for i, v in zip(index, value))
        expected += sum(model.v[a] @ model.v[b] * x * y for k, (a, x) in enumerate(zip(index, value)) for b, y in list(zip(index, value))[k + 1 :])
        assert abs(margin - expected) < 1e-9


def test_media_columns_by_hand(spark):
    docs = documents(spark, SF).select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    texts = Counter((d, t) for d, t in docs.collect())
    found = jpeg.media_features(docs).collect()
    assert len(found) == sum(texts.values())
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for d, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        expected = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        mine = [r for r in by_id[d] if tuple(r)[1:5] == expected]
        assert mine, d
        media, at, shown = jpeg.encode(payload), 0, []
        assert (mine[0].media_bytes, mine[0].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        while at < len(media):
            image, at = jpeg.parse(media, at)
            shown.append(f"{image.width}x{image.height}:{jpeg.difference_hash(jpeg.thumbnails([image])[0])}")
        assert mine[0].feature == ",".join(shown)


def test_difference_hash_by_hand():
    rng = np.random.default_rng(4)
    thumb = rng.integers(0, 256, (16, 18)).astype(np.uint8)
    bits = []
    for r in range(8):
        cells = [int(thumb[2 * r : 2 * r + 2, 2 * c : 2 * c + 2].sum()) for c in range(9)]
        bits += [a > b for a, b in zip(cells, cells[1:])]
    assert jpeg.difference_hash(thumb) == np.packbits(np.array(bits).reshape(8, 8)).tobytes().hex()


@pytest.mark.parametrize("cut", [3, 0.2, 0.5, 0.9, 0.999])
def test_truncated_images_are_errors(cut):
    data = jpeg.encode(bytes(range(256)) * 4)
    part = data[: cut if cut >= 1 else int(cut * len(data))]
    with pytest.raises((ValueError, IndexError, KeyError)):
        image, _ = jpeg.parse(part, 0)
        jpeg.thumbnails([image])


def test_personal_data_columns_by_plain_expressions(spark):
    plain = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    docs = documents(spark, SF)
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    for d, text in docs.select("doc_id", "text").collect():
        base = []
        for k, (_, p) in enumerate(plain):
            for m in re.finditer(p, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if (k == 0, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), k == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits), k == 3 and 10 <= len(digits) <= 15)[k]:
                    base.append((m.start(), k, m.end()))
        shown = [f"{plain[k][0]}:{a}:{b}" for a, k, b in sorted(base)]
        r = found[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and [x for x in r.spans.split(",") if x.split(":")[0] in dict(plain)] == shown


def test_context_decides_a_social_security_number():
    number = "123-45-6789"
    kinds = lambda text: [k for _, k, _, _ in pii.spans(text)]
    assert 5 in kinds(f"my ssn is {number}") and 5 not in kinds(f"part {number} fits")
    assert "[SSN]" in pii.redacted(f"ssn {number}") and number in pii.redacted(f"part {number}")


def test_the_language_model_over_several_blocks(spark):
    """A partition is a block at least: the exchange of counts is of six. Base columns don't depend on the cut, and training still raises held-out scores."""
    docs = documents(spark, SF)
    one, six = (hmm.score(d, remainder(7) == 2).toPandas().set_index("doc_id").sort_index() for d in (docs.coalesce(1), docs.repartition(6, "doc_id")))
    for c in ("held_out", "n_tokens", "n_known", "train_tokens"):
        assert (one[c] == six[c]).all()
    assert np.allclose(one.base_score, six.base_score)
    held = six.held_out
    first = hmm.score(docs.repartition(6, "doc_id"), remainder(7) == 2, rounds=1, inner=1).toPandas().set_index("doc_id").sort_index()
    assert six.score[held].sum() > first.score[held].sum() and six.score[~held].sum() > six.base_score[~held].sum()


def test_parts_are_handed_on_early(monkeypatch):
    """The sum over all that a task hands on is the same, however early."""
    rng = np.random.default_rng(2)
    batches = [pa.RecordBatch.from_pydict({"part": [f"p{k}" for k in rng.integers(0, 9, 50)], "mask": pa.array(rng.integers(0, 32, 50), pa.int32()), "good": rng.random(50) < 0.5, "toxic": rng.random(50) < 0.1}) for _ in range(4)]

    def summed():
        out, handed = {}, 0
        for batch in audit.removals(iter(batches)):
            handed += 1
            for part, *arrays in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out[part] = out.get(part, 0) + np.array(arrays)
        return out, handed

    whole, once = summed()
    monkeypatch.setattr(audit, "PARTS", 2)
    early, often = summed()
    assert once == 1 < often and whole.keys() == early.keys() and all((whole[p] == early[p]).all() for p in whole)
    for p, arrays in whole.items():
        rows = [(m, g) for b in batches for q, m, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) if q == p]
        for k, order in enumerate(audit.ORDERS):
            at = [next((s for s, f in enumerate(order) if m >> "ABCDE".index(f) & 1), 5) for m, _ in rows]
            assert arrays[0][6 * k : 6 * k + 6].tolist() == [at.count(s) for s in range(6)]
            assert arrays[1][6 * k : 6 * k + 6].tolist() == [sum(s == x and g for x, (_, g) in zip(at, rows)) for s in range(6)]


def test_odd_tables_by_value(spark):
    docs = odd(spark)
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert found == {(1, 0, 1, True): 1, (2, 0, 2, True): 1, (3, 1, 3, True): 2, (None, 1, None, True): 1, (4, 97, 4, True): 1, (5, 98, 4, False): 1, (6, 0, 6, True): 1}
    spans = {(r.doc_id, r.n_email, r.spans) for r in pii.find(docs).collect()}
    assert spans == {(d, 0, "") for d in (1, 2, 3, None, 4, 5, 6)}
    cut = Counter((r.doc_id, r.text, r.n_removed) for r in substring.dedup(docs).collect() if r.doc_id not in (4, 5))
    assert cut == {(1, None, 0): 1, (2, "", 0): 1, (3, "one two", 0): 2, (None, "three", 0): 1, (6, " \n\t ", 0): 1}
    pieces = packing.pack(docs).toPandas()
    assert pieces[pieces.doc_id.isin([1, 2])].length.tolist() == [1, 1] and (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    model = quality.fit(docs, spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int"))
    scores = quality.score(docs, model).collect()
    assert len(scores) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.KEEP) for r in scores)
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in scores)
