import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadsift.llm import infilling


def plain_infilling(doc_id, text):
    """(n, form, prefix length, middle length, output) by the rules, one text at a time."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * at : 8 * at + 8], 16) for at in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 20
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), output


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _check(docs, rows):
    got = sorted(map(repr, docs))
    want = []
    for doc_id, text in rows:
        n, form, prefix, middle, output = plain_infilling(doc_id, text)
        want.append(repr((doc_id, n, form, prefix, middle, _sha(output), _sha(text or ""))))
    assert got == sorted(want)


def test_equals_plain_rules_on_odd_rows(make_docs, odd_docs, no_docs):
    texts = ["<", "<P", "<P><S>", "a<M>b", "<<P", "P>x<", "S><", "é", "éa", "aé", "a\nb\r\n", "\U0001f600\U0001f600ab", "<S", "M>", "\x00", None, ""]
    rows = [(at * 7 + shift, text) for at, text in enumerate(texts * 3) for shift in (0, 1)]
    _check((tuple(row) for row in infilling.digests(make_docs(*rows)).collect()), rows)
    odd = [(row["doc_id"], row["text"]) for row in odd_docs.collect()]
    _check((tuple(row) for row in infilling.digests(odd_docs).collect()), odd)
    assert infilling.digests(no_docs).collect() == []


@pytest.mark.parametrize("stride", [1, 3, 7, 1 << 20])
def test_any_stride_scatters_and_gathers_alike(monkeypatch, stride):
    monkeypatch.setattr(infilling, "STRIDE", stride)

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.tuples(st.text(alphabet="aB<>PSM é\u4e2d\U0001f600\n", max_size=12), *[st.integers(0, 2**32 - 1)] * 4), min_size=1, max_size=8))
    def check(rows):
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(rows)), pa.int64()), pa.array([row[0].encode() for row in rows], pa.binary()), *(pa.array([row[at] for row in rows], pa.int64()) for at in range(1, 5))],
            names=["doc_id", "text", "h1", "h2", "h3", "h4"],
        )
        found = infilling.cut_and_moved(batch, 90, 20)
        forms = found.column("form").to_pylist()
        for (text, h1, h2, h3, h4), n, form, output in zip(rows, found.column("n").to_pylist(), forms, found.column("output").to_pylist()):
            units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
            a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
            p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            kept = not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
            assert n == len(units) and form == ("plain" if kept else "spm" if h4 % 100 < 20 else "psm")
            assert output.decode() == {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        outputs, offsets = infilling._bytes_of(found.column("output"))
        data, back = infilling.gather(outputs, offsets, np.array(forms, dtype="U5"))
        assert [bytes(data[a:b]).decode() for a, b in zip(back[:-1], back[1:])] == [row[0] for row in rows]

    check()


def test_a_damaged_output_is_refused():
    output = np.frombuffer(b"<P>ab<S>cd", np.uint8)
    with pytest.raises(ValueError):
        infilling.gather(output, np.array([0, len(output)]), np.array(["psm"]))
