import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from meridian.llm import words as w
from meridian.llm.warc import parse_arc, write_arc

from .conftest import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té\u00a0'.", max_size=60)), min_size=1, max_size=8)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_scan_finds_the_words_of_every_text(texts):
    data, offsets = w.text_buffer(pa.array(texts, pa.string()))
    found = w.scan(data, offsets, w.SPACED, w.LOWER)
    for d, text in enumerate(texts):
        a, b = found.first[d], found.first[d + 1]
        raw = [data[x:y].tobytes().decode() for x, y in zip(found.starts[a:b], found.ends[a:b])]
        assert raw == words(text)
    by_hash = {}
    for s, e, h in zip(found.starts, found.ends, found.hashes):
        assert by_hash.setdefault(int(h), w.LOWER[data[s:e]].tobytes()) == w.LOWER[data[s:e]].tobytes()


def test_scan_is_the_same_in_small_pieces(monkeypatch):
    texts = pa.array(["ab cd " * 50, "x" * 400, None, "end"])
    data, offsets = w.text_buffer(texts)
    whole = w.scan(data, offsets)
    monkeypatch.setattr(w, "PIECE", 16)
    parts = w.scan(data, offsets)
    for a, b in zip(whole, parts):
        assert (a == b).all()


def test_rolling_hashes_tell_runs_apart():
    hashes = np.array([1, 2, 3, 1, 2, 3, 2], np.uint64)
    found = w.rolling(hashes, 3)
    assert found[0] == found[3] and len(set(found.tolist())) == 4
    assert w.whole_runs(np.array([0, 4, 7]), 3, 7).tolist() == [True, True, False, False, True]


@given(st.lists(st.tuples(st.text(alphabet="ab /\n ", max_size=9), st.binary(max_size=40)), max_size=5), st.sampled_from([1, 2]))
@settings(max_examples=60, deadline=None)
def test_arc_round_trip(records, version):
    data = write_arc([(url, "1.2.3.4", "text/html", body) for url, body in records], version)
    assert [r.body for r in parse_arc(data)] == [body for _, body in records]
