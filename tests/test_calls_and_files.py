import io
import zipfile

import pytest

from wikiloom.operators import tables
from wikiloom.operators.calls import CallError, Caller, answered
from wikiloom.sources import docx, wiki


class Flaky:
    """A callable that fails as it is told, and its log of calls and waits."""

    def __init__(self, *errors):
        self.errors, self.models, self.waits = list(errors), [], []

    def __call__(self, model, request):
        self.models.append(model)
        error = self.errors.pop(0) if self.errors else None
        if error is not None:
            raise error if isinstance(error, Exception) else CallError(error)
        return f"{model}: {request}"


def caller(flaky, models=("a", "b"), **more):
    return Caller(flaky, models, sleep=flaky.waits.append, jitter=lambda: 0.25, **more)


def test_waits_double_then_the_next_model():
    flaky = Flaky(500, 429, None)
    assert caller(flaky)("q") == ("a", "a: q") and flaky.models == ["a"] * 3 and flaky.waits == [1.25, 2.25]
    flaky = Flaky(500, 500, 500, 500, None)
    assert caller(flaky)("q") == ("b", "b: q") and flaky.models == ["a"] * 4 + ["b"] and flaky.waits == [1.25, 2.25, 4.25]


def test_overloaded_models_are_left_after_two():
    flaky = Flaky(503, 503, 503, 429, None)
    assert caller(flaky)("q")[0] == "b" and flaky.models == ["a", "a", "b", "b", "b"]


def test_errors_that_do_not_pass():
    for error in (400, 401, ValueError("x")):
        flaky = Flaky(error)
        with pytest.raises((CallError, ValueError)):
            caller(flaky)("q")
        assert flaky.models == ["a"] and flaky.waits == []
    flaky = Flaky(TimeoutError(), CallError(None), ConnectionError(), None)
    assert caller(flaky)("q")[0] == "a"
    flaky = Flaky(*[503] * 9)
    with pytest.raises(CallError, match="503"):
        caller(flaky, ("a", "b", "a"))("q")
    assert flaky.models == ["a", "a", "b", "b"]
    with pytest.raises(ValueError, match="no models"):
        caller(Flaky(), ())("q")


def test_pace():
    now = [0.0]
    flaky = Flaky()
    slow = Caller(flaky, ("a",), per_second=2, sleep=lambda s: (flaky.waits.append(s), now.__setitem__(0, now[0] + s)), clock=lambda: now[0])
    for _ in range(4):
        slow("q")
    assert flaky.waits == [0.5] * 3


def test_answers_of_a_table(spark):
    def make():
        def call(model, prompt):
            if "bad" in prompt:
                raise CallError(400, "bad request")
            if model == "first":
                raise CallError(503)
            return prompt.upper()

        return Caller(call, ("first", "second"), sleep=lambda s: None)

    got = answered(spark.createDataFrame([(1, "x"), (2, "bad"), (3, None)], "id int, prompt string"), make)
    assert sorted(map(tuple, got.collect())) == [(1, "X", "second", None), (2, None, None, "bad request"), (3, None, None, None)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def made(body, name="word/document.xml", head="", rels=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, f"<?xml version='1.0'?>{head}<w:document {W}><w:body>{body}</w:body></w:document>")
        if rels:
            z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="{docx.OFFICE_DOCUMENT}" Target="{rels}"/></Relationships>')
    return out.getvalue()


def p(*runs):
    return "<w:p><w:pPr><w:t>style</w:t></w:pPr>" + "".join(r if r.startswith("<") else f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"


def test_docx():
    body = p("Hej ", "världen") + p() + "<w:tbl><w:tr><w:tc>" + p("a", "<w:r><w:tab/></w:r>", "b") + "</w:tc><w:tc>" + p("c", "<w:r><w:br/></w:r>", "d &amp; e") + "</w:tc></w:tr></w:tbl>"
    body += p("kept", "<w:del><w:r><w:t>gone</w:t></w:r></w:del>", "<w:ins><w:r><w:t> new</w:t></w:r></w:ins>", "<w:r><w:instrText>PAGE</w:instrText></w:r>")
    body += p("<w:r><mc:AlternateContent><mc:Choice Requires='x'><w:t>twice</w:t></mc:Choice><mc:Fallback><w:t>once</w:t></mc:Fallback></mc:AlternateContent></w:r>")
    assert docx.docx_text(made(body)) == "Hej världen\n\na\tb\n\nc\nd & e\n\nkept new\n\nonce"
    assert docx.docx_text(made(p("moved"), "content/main.xml", rels="/content/main.xml")) == "moved"
    assert docx.docx_text(made("")) == ""
    assert docx.docx_text(made("<w:sdt>" * 3000 + p("deep") + "</w:sdt>" * 3000)) == "deep"


def test_docx_that_is_refused(monkeypatch):
    for data in (b"", b"no zip", made(p("x"))[:60]):
        with pytest.raises(Exception):  # noqa: B017
            docx.docx_text(data)
    with pytest.raises(ValueError, match="document type"):
        docx.docx_text(made(p("&a;"), head='<!DOCTYPE x [<!ENTITY a "b">]>'))
    monkeypatch.setattr(docx, "LARGEST_PART", 1 << 20)
    with pytest.raises(ValueError, match="bytes"):
        docx.docx_text(made(p("0" * (2 << 20))))


def test_docx_of_a_table(spark):
    files = spark.createDataFrame([("a.docx", None, bytearray(made(p("Semester")))), ("b.docx", None, bytearray(b"broken")), ("c.txt", None, bytearray(b"plain")), ("d.docx", None, None), ("e", wiki.WORD_TYPES[0], bytearray(made(p("typed"))))], "file_name string, media_type string, content binary")
    assert {r["file_name"]: r["text"] for r in wiki.extract_text(files).collect()} == {"a.docx": "Semester", "b.docx": "", "c.txt": "plain", "d.docx": "", "e": "typed"}


def test_parents_without_new_children(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], "page_id int, chunk_index int, content string")
    new = spark.createDataFrame([(1, 4, "n")], old.schema)
    again = spark.createDataFrame([(1,), (2,), (9,)], "page_id int")
    assert sorted(map(tuple, tables.replace_children(old, new, "page_id", "chunk_index", again).collect())) == [(1, 0, "n"), (3, 0, "c")]
