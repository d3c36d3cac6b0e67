import json
import os
import tempfile


def fetch(offset, limit):
    """A listing of 120 pages."""
    return [(str(i), f"Page {i}", "S", f"/pages/{i}", "<p>x</p>") for i in range(offset, min(offset + limit, 120))]


def attachments(page, offset, limit):
    """Page 1 has 250 attachments, page 2 none, page 3 exactly one listing page."""
    have = {"1": 250, "2": 0, "3": 100}[page]
    return [(f"a{page}-{i}", f"f{i}.txt", "text/plain", i, 1, f"/d/{i}") for i in range(offset, min(offset + limit, have))]


#: A file of [id, text, time] for each change, which tests write and the stream's tasks read.
CHANGES = os.path.join(tempfile.gettempdir(), f"wikiloom-changes-{os.getuid()}.json")


def _all():
    with open(CHANGES) as f:
        return json.load(f)


def newest():
    return max((t for *_, t in _all()), default=None)


def changes(first, before, offset, limit):
    found = sorted((t, i, text) for i, text, t in _all() if first <= t < before)
    return [(str(i), f"Page {i}", "S", f"/pages/{i}", text, t) for t, i, text in found[offset : offset + limit]]
