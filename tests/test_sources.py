import os
import tempfile

from logweave.sources import readers as rd


NGINX = ('10.0.0.1 - - [10/Apr/2026:10:00:00 +0000] "GET /login?x=1 HTTP/1.1" 200 512 "-" "curl/8.0"\n'
         '   \n'
         '10.0.0.2 - - [10/Apr/2026:10:00:01 +0000] "POST /api HTTP/2.0" 404 -\n'
         'broken line\n'
         '10.0.0.3 - - [10/Apr/2026:10:00:02 +0000] "GET / HTTP/1.1" 500 12 "" ""\n')
APP = ('2026-04-10 10:00:00 ERROR app.core failed to connect\n'
       '2026/04/10 10:00:01,250 INFO started\n'
       'something WARNING happened\n'
       'no level at all\n')


def _write(text):
    d = tempfile.mkdtemp(prefix="logweave-src-")
    path = os.path.join(d, "x.log")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_nginx_detect_and_parse(spark):
    df = rd.read_text_log(spark, _write(NGINX))
    rows = [r.asDict() for r in df.orderBy("__row_id").collect()]
    assert len(rows) == 4  # blank line dropped
    assert rows[0]["remote_addr"] == "10.0.0.1" and rows[0]["status_code"] == 200 and rows[0]["bytes_sent"] == 512
    assert rows[0]["referer"] == "-" and rows[0]["user_agent"] == "curl/8.0"
    assert rows[1]["bytes_sent"] is None and rows[1]["referer"] is None and rows[1]["user_agent"] is None
    assert rows[2]["log_type"] == "generic_log" and rows[2]["remote_addr"] is None
    assert rows[3]["referer"] == "" and rows[3]["user_agent"] == ""


def test_generic_parse(spark):
    df = rd.read_text_log(spark, _write(APP))
    rows = [r.asDict() for r in df.orderBy("__row_id").collect()]
    assert (rows[0]["level"], rows[0]["source"], rows[0]["message"]) == ("ERROR", "app.core", "failed to connect")
    assert rows[1]["event_time"] == "2026/04/10 10:00:01,250" and rows[1]["source"] is None
    assert rows[1]["message"] == "started"
    assert rows[2]["level"] == "WARNING" and rows[2]["message"] == "something WARNING happened"
    assert rows[3]["level"] is None and rows[3]["event_time"] is None


def test_csv_header_and_missing_tokens(spark):
    path = _write(" a ,a,,b c\n1,x,N/A,2.5\n2,NA,,3\n")
    df = rd.read_csv(spark, path)
    assert df.columns == ["a", "a_2", "Unnamed:_2", "b_c"]
    rows = [r.asDict() for r in df.orderBy("a").collect()]
    assert dict(df.dtypes)["a"] == "bigint" and dict(df.dtypes)["b_c"] == "double"
    assert rows[1]["a_2"] is None and rows[0]["Unnamed:_2"] is None


def test_clean_header():
    assert rd.clean_header(["x", " x ", " ", "a  b", ""]) == ["x", "x_2", "unnamed", "a_b", "unnamed_2"]
    assert rd.pandas_header_names(["a", "a", None, "a.1"]) == ["a", "a.1", "Unnamed: 2", "a.1.1"]
