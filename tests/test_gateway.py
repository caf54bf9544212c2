import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from tallyweir import gateway
from tallyweir.plans.engine import Engine
from tallyweir.plans.spec import MeasureSpec, Rollup
from tallyweir.sources import observations as o
from tallyweir.streaming import rollup as s

ROLLUP = Rollup("country", ("country",), (MeasureSpec("count"), MeasureSpec("max", "height")))


@pytest.fixture
def front(spark, tmp_path):
    kept = s.RollupTable(spark, str(tmp_path / "kept"), ROLLUP)
    engine = Engine()
    engine.create_kept(kept)
    http = gateway.server(engine, spark, str(tmp_path / "in"), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", tmp_path, kept
    http.shutdown()


def ask(url, data=None, method=None, kind=None):
    request = urllib.request.Request(url, data, {"Content-Type": kind} if kind else {}, method=method)
    if data is not None and kind is None:
        request.add_header("Content-Type", "text/plain")
    try:
        with urllib.request.urlopen(request) as r:
            return r.status, r.read().decode(), r.headers
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(), e.headers


def test_from_posting_to_answer(spark, front):
    url, tmp, kept = front
    lines = b"1|country=US|height=9078\n2|country=US|height=-54\nbad\n"
    assert ask(f"{url}/obs", lines)[0] == 200
    form = urllib.parse.urlencode({"data": "3|country=FR|height=535"}).encode()
    assert ask(f"{url}/obs", form, kind=gateway.FORM)[0] == 200
    good, _ = o.split(o.parse(o.stream_lines(spark, str(tmp / "in"))))
    s.keep(o.fields(good, ["country", "height"]), [kept], str(tmp / "check"), available_now=True).awaitTermination()
    q = urllib.parse.quote("select max(height), count(*) where country='US'")
    status, text, headers = ask(f"{url}/collation/country?q={q}")
    assert (status, text) == (200, "country=US\nmax(height)=9078\ncount(*)=2\n")
    assert "no-cache" in headers["Cache-Control"]
    assert ask(f"{url}/collation/country?q={q}", method="POST")[1] == text
    assert ask(f"{url}/collation/")[:2] == (200, "country\n")
    q = urllib.parse.quote("select max(height) where country='XX'")
    assert ask(f"{url}/collation/country?q={q}")[:2] == (200, "country=XX\n")


def test_refusals(front):
    url, tmp, _ = front
    assert ask(f"{url}/obs")[0] == 405
    assert ask(f"{url}/obs", b"x", kind="application/json")[0] == 415
    assert ask(f"{url}/obs", b"x", kind="nonsense")[0] == 400
    assert ask(f"{url}/obs", b"data=", kind=gateway.FORM)[0] == 400
    assert ask(f"{url}/collation/a/b?q=x")[0] == 404
    assert ask(f"{url}/collation/country")[0] == 400
    assert ask(f"{url}/collation/none?q=" + urllib.parse.quote("select count(*) where a='b'"))[0] == 404
    assert ask(f"{url}/collation/country?q=" + urllib.parse.quote("select min(height) where country='b'"))[0] == 400
    assert ask(f"{url}/collation/country", method="DELETE")[0] == 405
    assert ask(f"{url}/else")[0] == 404
    assert not (tmp / "in").exists()


def test_octets_and_no_type():
    assert gateway.posting(None, b"a") == gateway.posting("application/octet-stream", b"a") == gateway.posting("text/plain; charset=utf-8", b"a") == b"a"
