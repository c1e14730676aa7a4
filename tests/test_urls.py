"""URLs accepted and refused by the URL standard."""

from tramline.functions.urls import valid_url

GOOD = """
http://example.com|https://example.com/|HTTP://EXAMPLE.COM:80/a?b#c|http:example.com|http:/example.com|http:\\\\example.com\\a|http:////example.com//x|https://user:pw@example.com/|http://a@b@example.com/
http://example.com:/|http://example.com:0/|http://example.com:65535/|http://example.com:0000080/|http://192.168.0.1|http://0x7f.1/|http://127.1/|http://1/|http://4294967295/|http://0xffffffff/
http://017700000001/|http://1.2.3/|http://256.example/|http://1.2.3.4./|http://[::1]/|http://[2001:db8::1]:8080/|http://[1:2:3:4:5:6:7:8]|http://[::ffff:1.2.3.4]/|http://[1::]/|http://[1:2:3:4:5:6:1.2.3.4]/
http://ex%61mple.com/|http://example.com/%|http://example.com/a b|http://example.com?q=<>|http://a_b.example/|http://a-.-b/|http://example..com/|http://./|http://a'b!$&()*+,;=c/|http://münchen.example/|http://日本語。jp/
http://EXAMPLE.com/|http://xn--mnchen-3ya.example/|ftp://f.example.com/x|ws://h|wss://h:1|file:|file:///c:/x|file://host/share|file:a|file://localhost/|file://c:/x|mailto:x@example.com|javascript:alert(1)|a:|tel:+1 555|data:,x y
urn:isbn:1|foo://|foo:///x|foo://host|foo://ho%st/|foo://h:80/|foo://[::1]/|about:blank|news:x|x-y+z.1:ok|http://example.com/\x7f|  http://example.com  |ht<LF>tp://ex\tample.com/|http://fo\u00ado/|http://a.b.c.d.e.f/|http://a\\@b:c
"""
BAD = """
|example.com|www.example.com/a|//example.com|/a/b|not a url|1http://example.com|:x|://x|http|ht tp://x|-a:b|http:|http://|https:///|http://?x|http://#x|http://:80/|http://@/|http://user@/|http://user:pw@:80/
http://a b/|http://a<b/|http://a>b/|http://a^b/|http://a|PIPE|b/|http://a%b/|http://%20/|http://%00/|http://a%2Fb/|http://%zz/|http://[::1|http://[::1]x/|http://[:::1]/|http://[1:2:3:4:5:6:7]/|http://[1:2:3:4:5:6:7:8:9]/
http://[12345::]/|http://[g::1]/|http://[::1.2.3]/|http://[::1.2.3.256]/|http://[::01.2.3.4]/|http://[1::2::3]/|http://[fe80::1%25eth0]/|http://[]/|http://a]b/|http://a[b/|http://example.com:x/|http://example.com:65536/|http://example.com:8a/|http://example.com:-1/
http://256.256.256.256/|http://1.2.3.4.5/|http://1.2.3.08/|http://1.2.3.0x1g.1.2.3.4.5.6/|http://4294967296/|http://1.2.3.256/|http://999.1/|http://a.b.09/|http://0xfffffffff/|http://1..2/|http://\ue000/|http://\u0301a/|http://\xad/|http://xn--/|http://\x7f/
foo://a b/|foo://a<b/|foo://h:x/|foo://:80/|foo://u@/x|foo://[::g]/|foo://a^b|file://a b/|file://h:80/|file://a%|file://u@h/|ftp://|ws:|wss:///|http://ex\u3000ample.com/|http://ex ample.com/
"""


def table(text):
    """Between bars or lines; PIPE is a bar and <LF> a line end within a URL."""
    return [x.replace("<LF>", "\n").replace("PIPE", "|") for x in text.strip("\n").replace("|PIPE|", "PIPE").replace("\n", "|").split("|")]


def test_accepted_and_refused(spark):
    good, bad = table(GOOD), table(BAD)
    assert len(good) + len(bad) > 150
    rows = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "u string, good boolean")
    got = rows.select("u", "good", valid_url(rows["u"]).alias("got")).collect()
    assert [(x.u, x.good) for x in got if x.good != x.got] == []


def test_null_and_long(spark):
    rows = spark.createDataFrame([(None,), ("http://" + "a" * 100_000 + ".example/",), ("x" * 100_000,)], "u string")
    assert [x[0] for x in rows.select(valid_url(rows["u"])).collect()] == [None, True, False]
