from tillroll.llm import url_vocab as U

URLS = [None, "", "no scheme", "http://", "HTTPS://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://xexample.org/en/12",
        "http://org", "http://org/", "http://a.com/fr/1", "http://a.com/de/1", "http://a.com?/fr/", "http://a.com/x://b",
        "http://casino.net/", "http://casinos.net/", "http://x.net/hot-nude", "http://x.net/hot-hot", "http://x.net/%C3%A9?sex=1&bet",
        "http://" + "a." * 5000 + "com/de/", "http://ADS-TRACK.net/q", "http://éporn.net/"]


def test_parity_with_sql_and_cases(spark):
    import duckdb
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://a.com/fr/", "h"), (3, "http://", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(map(tuple, U.judge(df).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, host VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert got == sorted(con.execute(U.oracle_sql()).fetchall(), key=str)
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[0][1:5] == ("", "", None, "allow")
    assert by[4][1:5] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[5][3:5] == ("example.org/en/1", "block") and by[6][3:5] == ("org/", "allow")
    assert by[7][3] is None and by[8][3] == "org/"
    assert by[13][4] == "block" and by[14][4] == "allow" and by[15][4] == "block" and by[16][4] == "allow"
    assert U.judge(df.limit(0)).count() == 0
