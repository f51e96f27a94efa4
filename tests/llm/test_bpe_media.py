import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from skymosaic.llm import byte_bpe, media

TEXTS = ["", None, "Hello world!! 123", "aaaaaaaaaaaaaaaaaaaa", "a" * 70_000, "ñandú é́ 日本語 🙂🙂", "  lead\n\n\ttabs  ", "don't we'll THE!! ERERER!!", "Thhaen " * 50, "<|endoftext|>"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "x", t) for i, t in enumerate([*TEXTS, TEXTS[2]])], "doc_id long, text string, ids string, decoded string")


def test_encoder_equals_tiktoken_and_plain_merges():
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(byte_bpe.vocabulary_tables(ranks))
    rng = np.random.default_rng(1)
    for alphabet in ("ab", "theandrio ", "aeiou'.,!", "éèñthonre"):
        for _ in range(300):
            s = "".join(rng.choice(list(alphabet), rng.integers(1, 40)))
            found = encoder.piece(s.encode().decode("latin-1"))
            assert found == own._core_bpe.encode_single_piece(s.encode())
            assert found == [ranks[x] for x in byte_bpe.merge_all(s.encode(), ranks)]


def test_encode_decode_round_trip(spark, rows):
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_decoded=True)
    got = {r.doc_id: r for r in byte_bpe.digest(encoded).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    again = byte_bpe.decode(encoded.drop("decoded"), P.path("byte_bpe_50k.tiktoken")).collect()
    assert all(bytes(r.decoded).decode() == ([*TEXTS, TEXTS[2]][r.doc_id] or "") for r in again)
    assert byte_bpe.encode(rows.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_two_vocabularies_in_one_session(spark, tmp_path):
    """Workers outlive queries: each query is answered by its own vocabulary and pattern."""
    small = tmp_path / "bytes.tiktoken"
    small.write_bytes(b"\n".join(base64.b64encode(bytes([k])) + b" %d" % k for k in range(256)))
    one = spark.createDataFrame([(1, "hello world")], "doc_id long, text string").coalesce(1)
    counts = [byte_bpe.encode(one, path, pattern).first().n_tokens for path, pattern in ((P.path("byte_bpe_50k.tiktoken"), P.PATTERN), (str(small), P.PATTERN), (P.path("byte_bpe_50k.tiktoken"), P.PATTERN), (P.path("byte_bpe_50k.tiktoken"), "."))]
    assert counts == [2, 11, 2, 11]


def test_frequency_hash_is_that_of_the_plain_transform():
    rng = np.random.default_rng(3)
    for shape in ((40, 64), (1, 64), (32, 32), (500, 64)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        edge = lambda n: [int(k * n / 32) for k in range(33)]
        ys, xs = edge(shape[0]), edge(shape[1])
        small = np.array([[image[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)].mean() for j in range(32)] for i in range(32)])
        low = [[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        low = np.round(np.array(low), 6).ravel().tolist()
        middle = sorted(low[1:])[31]  # of 63 values
        assert media.frequency_hash(image) == f"{int(''.join('1' if v > middle else '0' for v in low), 2):016x}"


def test_png_filters_and_checksums():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    data = media.encode_png(image.ravel())
    assert (media.decode_png(data) == image).all()
    # all five filters, written by the plain rules
    rows = []
    for y in range(40):
        kind, up = y % 5, image[y - 1].astype(int) if y else np.zeros(64, int)
        out = []
        for x in range(64):
            a, b, c = int(image[y, x - 1]) if x else 0, int(up[x]), int(up[x - 1]) if x else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        rows.append(bytes([kind, *out]))
    header = data[8:33]
    built = data[:8] + header + media._chunk(b"IDAT", zlib.compress(b"".join(rows))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(built) == image).all()
    for at in (3, 20, 60, len(data) - 5):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))


def test_media_columns(spark, rows):
    got = {r.doc_id: r for r in media.digest(media.read_back(media.store(rows))).collect()}
    for i, t in enumerate([*TEXTS, TEXTS[2]]):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert got[i].n_bytes == len(raw) and got[i].payload_bytes == len(payload)
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[2].feature == got[len(TEXTS)].feature and got[0].media_sha256 == got[1].media_sha256
    assert media.store(rows.limit(0)).count() == 0
