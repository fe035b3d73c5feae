"""Functions of the core library against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions import stemming
from seqloom.operators import learners, media, statistics, transforms
from seqloom.sources import archive


def test_stems():
    english = {"consigned": "consign", "consistency": "consist", "consolation": "consol", "knitting": "knit", "generously": "generous", "relational": "relat", "hoping": "hope", "flies": "fli", "ties": "tie", "skies": "sky", "proceed": "proceed", "agreed": "agre", "plastered": "plaster", "happy": "happi", "cries": "cri", "by": "by"}
    assert {w: stemming.english(w) for w in english} == english
    german = {"aufeinander": "aufeinand", "kategorischen": "kategor", "katers": "kat", "häuser": "haus", "bedeutung": "bedeut"}
    assert {w: stemming.german(w) for w in german} == german
    french = {"continuation": "continu", "majestueusement": "majestu", "mangeaient": "mang", "chevaux": "cheval", "maisons": "maison"}
    assert {w: stemming.french(w) for w in french} == french


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyzéèüß'", max_size=20))
@settings(max_examples=300, deadline=None)
def test_stemmers_take_anything(word):
    for stem in stemming.STEMMERS.values():
        assert len(stem(word)) <= len(word.replace('ß', 'ss')) + 2  # ß is written ss


@given(st.binary(max_size=400))
@settings(max_examples=200, deadline=None)
def test_addresses_come_back(data):
    data = data.replace(b"\x01", b"\xe8").replace(b"\x02", b"\x00").replace(b"\x03", b"\xff")
    assert len(transforms.absolute_calls(data)) == len(data)
    assert transforms.absolute_calls(transforms.absolute_calls(data), True) == data
    assert transforms.absolute_calls(transforms.absolute_calls(data, True)) == data


def test_addresses_of_calls():
    data = b"\x90" * 10 + b"\xe8\x10\x00\x00\x00" + b"\x90" * 10 + b"\xe9\xf0\xff\xff\xff" + b"\x90" * 5
    coded = transforms.absolute_calls(data)
    assert coded != data and transforms.absolute_calls(coded, True) == data
    assert int.from_bytes(coded[11:14], "little") == 0x10 + 15


@given(st.lists(st.integers(0, 1), max_size=300))
@settings(max_examples=40, deadline=None)
def test_arithmetic_code(bits):
    for name in ("order2", "mixed", "graph"):
        data = learners.arithmetic_encode(learners.MODELS[name](), bits)
        assert learners.arithmetic_decode(learners.MODELS[name](), data, len(bits)) == bits


def test_learners_learn():
    bits = [0, 1, 1, 0] * 200
    for name, make in learners.MODELS.items():
        per = learners.cost(make(), bits) / len(bits)
        assert per < (1.05 if name == "order0" else 0.75), (name, per)
    assert learners.cost(learners.MODELS["mixed"](), bits) < learners.cost(learners.MODELS["order0"](), bits)


def test_lstm_learns():
    seq, net, costs = [0, 1, 2] * 300, learners.Lstm(3), []
    for s in seq:
        costs.append(-np.log2(net.predict()[s]))
        net.update(s)
    assert np.mean(costs[-90:]) < 0.5 * np.mean(costs[:90])


def test_capped_mean(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    values = [float(r.random() < 0.3) for _ in range(100)]
    p, n = 0.5, 0
    for v in values:
        p += (v - p) / (n + 1)
        n = min(n + 1, statistics.LIMIT - 1)
    row = spark.createDataFrame([(values,)], "v array<double>").select(statistics.capped_mean(F.col("v")).alias("p")).first()
    assert abs(row.p - p) < 1e-12


def test_automaton():
    states = statistics.automaton(np.array([1, 1, 1, 0, 0, 1]))
    assert states[2].tolist() == [0, 3, 1] and states[3].tolist() == [1, 2, 0]
    assert (statistics.automaton(np.ones(100, int))[-1] == [0, 40, 1]).all()


def test_online_least_squares():
    v = np.sin(np.arange(400) / 5)
    guess = statistics.online_least_squares(v)
    assert np.abs(v - guess)[-100:].mean() < 0.01


def test_prefix_codes():
    codes = {"a": (0, 1), "b": (2, 2), "c": (3, 2)}
    own = list("abcabacca")
    assert media.huffman_decode(media.huffman_bits(own, codes), codes) == own
    made = media.huffman_codes({"a": 50, "b": 3, "": 1})
    rare = ["a", "unseen", "b", "", "été", "a"]
    assert media.huffman_decode(media.huffman_bits(rare, made), made) == rare
    bits = sorted(f"{c:0{n}b}" for c, n in made.values())
    assert not any(b.startswith(a) for a, b in zip(bits, bits[1:]))
    assert [m for _, m in media.jpeg_markers(bytes.fromhex(media._JPEG))] == [0xD8, 0xE0, 0xDB, 0xC0, 0xC4, 0xDA]
    assert media.instructions(b"\xe8\0\0\0\0\x90\x66\x01\xc0") == [(0, 0xE8, False), (5, 0x90, False), (6, 0x01, True)]


def test_archive(spark):
    rows = [(1, "a" * 1000), (2, None), (3, ""), (4, "é日本"), (4, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = archive.encode(docs)
    assert {r.doc_id: r.flag for r in packed.collect() if r.doc_id < 4} == {1: 1, 2: -1, 3: 0}
    key = lambda r: (r[0], r[1] or "")
    assert sorted((tuple(r) for r in archive.decode(packed).select("doc_id", "text").collect()), key=key) == sorted(rows, key=key)
    assert isinstance(packed.toPandas(), pd.DataFrame)


def test_archive_knows_its_dictionary(spark):
    docs = spark.createDataFrame([(1, "the old river " * 30), (2, None), (3, "")], "doc_id long, text string")
    words = b"the old river"
    packed = archive.encode(docs, dictionary=words)
    assert {r.doc_id: r.text for r in archive.decode(packed, words).collect()} == {1: "the old river " * 30, 2: None, 3: ""}
    for made, given in ((packed, b""), (packed, b"another"), (archive.encode(docs), words)):
        with pytest.raises(Exception, match="another dictionary"):
            archive.decode(made, given).collect()


def test_lstm_gradients():
    net = learners.Lstm(3, cells=4, layers=2, horizon=99, seed=2)
    rng = np.random.default_rng(1)
    for k in net.w:
        net.w[k] = net.w[k] + rng.normal(0, 0.2, net.w[k].shape)
    seq = [0, 2, 1, 1, 0, 2]

    def cost():
        net.tape, net.last = [], 0
        net.c, net.out = np.zeros((2, 2, 4))
        total = 0.0
        for s in seq:
            total -= float(np.log(net.predict()[s]))
            net.update(s)
        return total

    cost()
    grads = net.gradients()
    for k, g in grads.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 4)]:
            old = net.w[k][at]
            net.w[k][at] = old + 1e-5
            up = cost()
            net.w[k][at] = old - 1e-5
            down = cost()
            net.w[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5, (k, at)
