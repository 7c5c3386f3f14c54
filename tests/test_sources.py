"""Sources over HTTP against a server on this machine, and dumps read in pieces of any size."""

import gzip
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest

from lexiloom.sources import dumps, files, splits, web

LINES = ["first", "", "a longer line of text", "中文 line", "x" * 300, "{}", "last without end"]
BODY = "\n".join(LINES).encode()
DUMP = "INSERT INTO `page` VALUES (1,0,'A_b',0),(2,0,'it\\'s (x),',1);\nother\n" * 40


class Handler(BaseHTTPRequestHandler):
    refused: set = set()

    def do_GET(self):
        if self.path.startswith("/page/"):
            title = unquote(self.path[6:])
            if title == "missing":
                return self.answer(404, b"")
            if title not in self.refused:  # each page is refused once
                self.refused.add(title)
                return self.answer(429, b"", {"Retry-After": "0"})
            return self.answer(200, json.dumps({"source": f"* '''{title}'''"}).encode())
        body = {"/lines": BODY, "/ranges": BODY, "/lines.gz": gzip.compress(BODY[:50]) + gzip.compress(BODY[50:]), "/dump.sql.gz": gzip.compress(DUMP.encode()), "/empty": b""}[self.path]
        wanted = self.headers.get("Range", "")
        if self.path == "/ranges" and wanted.startswith("bytes="):
            a, b = wanted[6:].split("-")
            part = body[int(a) : int(b) + 1 if b else None]
            return self.answer(206, part, {"Content-Range": f"bytes {a}-{int(a) + len(part) - 1}/{len(body)}"})
        self.answer(200, body)

    def answer(self, status, body, headers=None):
        self.send_response(status)
        for k, v in ({"Content-Length": str(len(body))} | (headers or {})).items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}"
    held.shutdown()


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_ranges_hold_every_line_once(server, size):
    parts = web.ranges(f"{server}/ranges", size)
    assert len(parts) == -(-len(BODY) // size)
    assert [x.decode() for a, b in parts for x in web.lines_of(f"{server}/ranges", a, b)] == LINES


def test_lines_equal_the_file_reader(spark, server, tmp_path):
    (tmp_path / "lines.txt").write_bytes(BODY)
    wanted = sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines.txt")).collect())
    for path in ("lines", "ranges", "lines.gz"):
        got = web.read_lines(spark, f"{server}/{path}", size=50)
        assert sorted(r["value"] for r in got.collect()) == wanted
    assert web.read_lines(spark, f"{server}/ranges", size=50).rdd.getNumPartitions() == -(-len(BODY) // 50)
    assert web.read_lines(spark, f"{server}/empty", f"{server}/lines", size=50).count() == len(LINES)
    rows = files.article_rows(spark.createDataFrame([('{"title": "t", "text": "x"}',), ("",), ('{"title": "t"}',), ("no json",)], "value string"))
    assert [tuple(r) for r in rows.collect()] == [("t", "x")]


def test_pages_wait_and_try_again(spark, server):
    titles = ["列表", "a/b c", "x", "y?"]
    for given in (titles, spark.createDataFrame([(t,) for t in titles], "title string")):
        Handler.refused.clear()
        pages = web.read_pages(spark, f"{server}/page/", given)
        assert {r["title"]: r["source"] for r in pages.collect()} == {t: f"* '''{t}'''" for t in titles}
    Handler.refused.clear()
    assert {r["word"] for r in dumps.list_words(web.read_pages(spark, f"{server}/page/", ["列表"])).collect()} == {"列表"}
    with pytest.raises(OSError):
        web.page(f"{server}/page/", "missing")
    Handler.refused.clear()
    with pytest.raises(OSError):
        web.page(f"{server}/page/", "refused", attempts=1)


def test_a_packed_dump_over_http(spark, server):
    lines = web.read_lines(spark, f"{server}/dump.sql.gz")
    got = sorted(r["fields"] for r in dumps.insert_tuples(lines, size=10).collect())
    assert got == sorted([["1", "0", "A_b", "0"], ["2", "0", "it\\'s (x),", "1"]] * 40)


def plain_tuples(data):
    """The texts of tuples, character by character."""
    out, own, quoted, skip = [], None, False, False
    for c in data:
        if own is None:
            own = "" if c == "(" else None
        elif quoted:
            own += c
            quoted, skip = (quoted, False) if skip else (c != "'", c == "\\")
        elif c == ")":
            out.append(own)
            own = None
        elif c == "(":
            own = ""
        else:
            own += c
            quoted = c == "'"
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 100, 1 << 16])
def test_pieces_of_any_size_give_the_same_tuples(spark, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab,()'\\\\中;\n") for _ in range(rng.randrange(12))) for _ in range(40)]
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    good = ",".join(f"({k},{quoted(t)},-1.5)" for k, t in enumerate(texts)) + ";"
    bad = ["".join(rng.choice("(),'\\a") for _ in range(30)) for _ in range(20)]
    every = [good, good[:-9], *bad]
    lines = [f"INSERT INTO `t` VALUES {x}" for x in every] + ["-- INSERT no", "INSERT nothing", "", None]
    got = splits.split_tuples(spark.createDataFrame([(x,) for x in lines], "value string"), size=size)
    assert sorted(r["tuple"] for r in got.collect()) == sorted(t for x in every for t in plain_tuples(x))
    fields = dumps.insert_tuples(spark.createDataFrame([(lines[0],)], "value string"), size=size)
    whole = dumps.insert_tuples(spark.createDataFrame([(lines[0],)], "value string"))
    assert sorted(r["fields"] for r in fields.collect()) == sorted(r["fields"] for r in whole.collect())
