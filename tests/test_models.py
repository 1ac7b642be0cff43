import numpy as np

from umbra.operators import models


def test_softmax_and_windows():
    p = models.softmax(np.array([[1000.0, 1000.0], [0.0, np.log(3)]]))
    assert np.allclose(p, [[0.5, 0.5], [0.25, 0.75]])
    assert models.token_windows(0) == [] and models.token_windows(5, 10) == [(0, 5)]
    assert models.token_windows(10, 4, 0.5) == [(0, 4), (2, 6), (4, 8), (6, 10)]
    assert models.token_windows(3, 1, 0.9) == [(0, 1), (1, 2), (2, 3)]


def test_windows_of_a_text_find_each_span_once():
    import re

    find = lambda t: [(*m.span(), "ID", 0.9) for m in re.finditer(r"#\d+#", t)]
    text = " ".join(f"#{i}#" for i in range(60))
    got = models.windowed(find, 40, "model")(text)
    assert [x[:2] for x in got] == [m.span() for m in re.finditer(r"#\d+#", text)]
    assert models.windowed(find, 40, "model", threshold=0.95)(text) == []


def test_providers():
    assert models.providers(["CUDA", "CPUExecutionProvider"], ["CPUExecutionProvider"]) == ["CPUExecutionProvider"]
    assert models.providers(["CUDA"], ["CUDA", "CPUExecutionProvider"]) == ["CUDA", "CPUExecutionProvider"]
