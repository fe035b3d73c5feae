import base64
import hashlib

import numpy as np
import pytest

from seqloom.llm import media, webp

STILL = "UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="
MOVING = "UklGRlIAAABXRUJQVlA4WAoAAAASAAAAAAAAAAAAQU5JTQYAAAD/////AABBTk1GJgAAAAAAAAAAAAAAAAAAAGQAAABWUDhMDQAAAC8AAAAQBxAREYiI/gcA"


@pytest.mark.parametrize("file", [STILL, MOVING])
def test_known_files(file):
    assert [f.tolist() for f in webp.decode(base64.b64decode(file))] == [[[0]]]


@pytest.mark.parametrize("kinds", [(), (0,), (1,), (2,), (0, 1, 2), (2, 0, 1)])
@pytest.mark.parametrize("cache", [0, 1, 11])
def test_any_image_comes_back(kinds, cache):
    rng = np.random.default_rng(len(kinds) + cache)
    for h, w in ((1, 1), (5, 7), (17, 23)):
        image = rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)
        if cache:
            image = image[rng.integers(0, h, (h, 1)), rng.integers(0, max(1, w // 3), (1, w))]
        for tile in (0, 2):
            assert (webp.decode_stream(webp.encode_image(image, kinds, cache, tile)) == image).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 16, 17, 256])
def test_palettes(n):
    rng = np.random.default_rng(n)
    colours = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    image = colours[rng.integers(0, n, (9, 13))]
    for kinds in ((3,), (2, 3), (3, 0)):
        assert (webp.decode_stream(webp.encode_image(image, kinds, 4)) == image).all()


def test_payloads_and_both_readers():
    rng = np.random.default_rng(3)
    own = [media.payload(x) for x in (b"", b"a", b"x" * 192, "é".encode() * 9000, rng.integers(0, 256, 30000).astype(np.uint8).tobytes(), b"a" * 50000)]
    files = media.encode_payloads(own)
    assert media.decode_payloads(files) == own
    for file, payload in zip(files, own):
        general = np.concatenate([((f >> 8) & 255).ravel() for f in webp.decode(file)])
        assert general.astype(np.uint8).tobytes() == payload


def test_ways_of_storing():
    """Each way is chosen by some strip, both readers agree on all, and none makes a file larger than storing the samples plainly."""
    rng = np.random.default_rng(8)
    ramp = (rng.integers(0, 256, (64, 1)) + 3 * np.arange(192)).astype(np.uint8).ravel()
    row = rng.integers(0, 256, 192).astype(np.uint8)
    rows = np.concatenate([row + k for k in range(64)]).astype(np.uint8)
    few = rng.choice([7, 65, 200], 64 * 192).astype(np.uint8)
    two = rng.choice([32, 97], 192).astype(np.uint8)
    prose = np.frombuffer(media.payload(b"plain prose, as most texts are: " + bytes(rng.integers(97, 123, 3000).astype(np.uint8))), np.uint8)
    strips = [ramp, rows, few, two, prose, np.full(192, 32, np.uint8), np.frombuffer(b"For " * 48 * 40, np.uint8)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in strips])])
    _, _, ways, _ = webp.choose_ways(np.concatenate(strips), bounds)
    assert set(ways.tolist()) == {webp.PLAIN, webp.LEFT, webp.TOP, webp.COLOURS}
    streams = webp.encode_frames(np.concatenate(strips), bounds)
    for strip, stream, back in zip(strips, streams, webp.decode_frames(streams)):
        assert (back == strip).all()
        assert (((webp.decode_stream(stream) >> 8) & 255).ravel() == strip).all()
    assert len(streams[0]) < 1000 and len(streams[1]) < 2000 and len(streams[2]) < 64 * 192 * 0.3


def test_equal_texts_are_stored_alike_in_any_block():
    texts = [b"", b"one text", b"x" * 500, b"The The The " * 900, "été ".encode() * 4000]
    together = media.encode_payloads([media.payload(t) for t in texts])
    alone = [media.encode_payloads([media.payload(t)])[0] for t in texts]
    assert together == alone
    assert media.decode_payloads(together[::-1]) == [media.payload(t) for t in texts[::-1]]


def test_damaged():
    file = media.encode_payloads([media.payload(b"some text")])[0]
    with pytest.raises(webp.Damaged):
        webp.decode(b"RIFF" + file[4:20])
    with pytest.raises(webp.Damaged):
        webp.decode(b"no" + file)


def test_rows(spark):
    rows = [(1, "ab", "x"), (2, None, "y"), (3, "", None), (4, "ab", "z"), (None, "é" * 40000, "q")]
    found = {r.doc_id: r for r in media.media_column(spark.createDataFrame(rows, "doc_id int, text string, n_bytes string")).collect()}
    assert len(found) == 5
    assert found[2].payload_bytes == 192 and found[2].n_bytes == 0 and found[2][3:] == found[3][3:]
    assert found[1][1:] == found[4][1:]
    assert found[1].payload_sha256 == hashlib.sha256(b"ab".ljust(192)).hexdigest()
    assert found[None].n_bytes == 80000 and found[None].payload_bytes % 192 == 0
    assert media.media_column(spark.createDataFrame([], "doc_id long, text string")).count() == 0
