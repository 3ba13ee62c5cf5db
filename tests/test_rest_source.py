import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from weirflow.sources import rest_source

PAGES = {"/a": {"items": [{"id": 1, "x": 1}, {"id": 2, "tags": ["t"]}], "next": "/b"}, "/b": {"items": [{"id": 3, "x": 2.5}]}, "/c": {"items": [{"id": 9}]}}


@pytest.fixture
def site():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps(PAGES[self.path]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_become_rows(spark, site):
    rest_source.register(spark)
    read = lambda **options: spark.read.format("weirflow_rest").schema("id long, x double, tags string").options(**options).load()
    params = {"url": f"{site}/a", "items_path": "items", "pagination": {"kind": "link"}}
    assert sorted(map(tuple, read(params=json.dumps(params)).collect())) == [(1, 1.0, None), (2, None, '["t"]'), (3, 2.5, None)]
    both = read(params=json.dumps({"items_path": "items"} | {"url": f"{site}/a"}), urls=json.dumps([f"{site}/a", f"{site}/c"]))
    assert sorted(r.id for r in both.collect()) == [1, 2, 9]
    with pytest.raises(Exception, match="http"):
        read(params=json.dumps({"url": "ftp://x"})).collect()
