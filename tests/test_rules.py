"""Single rules on hand-made rows."""

import hashlib
import hmac
import ipaddress
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.functions import device, identity, ip, source, text
from footfall.operators import admission, enrich


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_channels(spark):
    cases = {
        "google.com": ("Organic Search", "Google"), "bing.com": ("Organic Search", "Bing"),
        "facebook.com": ("Social Media", "Facebook"), "t.co": ("Social Media", "Twitter/X"),
        "outlook.live.com": ("Email", "outlook.live.com"), "blog.example.org": ("Referral", "blog.example.org"),
        "": ("Direct", ""), "0": ("Direct", ""),
        # order traps: an earlier rule wins
        "mail.google.com": ("Organic Search", "Google"), "www.reddit.com": ("Social Media", "Twitter/X"),
        "www.pinterest.com": ("Social Media", "Twitter/X"), "netflix.com": ("Social Media", "Twitter/X"),
        "eu.mail.aol.com": ("Email", "eu.mail.aol.com"), "xmail.aol.com": ("Referral", "xmail.aol.com"),
    }
    got = column(spark, list(cases), source.classify_channel)
    assert [tuple(r) for r in got] == list(cases.values())


def test_medium_overrides_domain(spark):
    got = column(spark, ["cpc", " Social ", "banner", ""], lambda m: source.classify_channel(F.lit("google.com"), m))
    assert [tuple(r) for r in got] == [
        ("Paid Search", ""), ("Social Media", ""), ("Organic Search", "Google"), ("Organic Search", "Google")
    ]


def test_source_attribution(spark):
    rows = [
        ("", "utm_source=marketingplatform.google.com&utm_medium=et", ("Organic Search", "Google", "marketingplatform.google.com")),
        ("https://semalt.com/x", "utm_medium=cpc", (None, None, None)),
        ("https://shop.test/a", "", ("Direct", "", "")),
        ("https://SHOP.test/a", "utm_source=News&utm_medium=email", ("Email", "News", "News")),
        ("https://www.google.com/", "utm_medium=cpc", ("Paid Search", "", "www.google.com")),
        ("", "utm_source=News", ("Referral", "news", "News")),
        ("not a url", "", ("Direct", "", "")),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, referrer string, page_query string")
    got = enrich.with_source(df, "shop.test").orderBy("i").select("channel", "source_name", "source_domain").collect()
    assert [tuple(r) for r in got] == [r[2] for r in rows]


def test_spam(spark):
    assert column(spark, ["semalt.com", "a.b.semalt.com", "notsemalt.com", "", None], source.is_spam_domain) == [True, True, False, False, False]


def test_utm(spark):
    got = column(spark, ["utm_source=a&utm_source=b%20c+d&utm_medium=0", "utm%5Fterm=k&utm_campaign=%zz", "", None, "utm_content=<b>x</b>%20"], source.extract_utm)
    assert got == [{"utm_source": "b c d"}, {"utm_term": "k", "utm_campaign": "%zz"}, {}, {}, {"utm_content": "x"}]


def test_referrer_parts(spark):
    urls = ["https://User@Mail.Google.com:8080/a?b#c", "//host/p", "example.com/x", "https://a.com?x", "http://a.com:99999/", "HTTP://X.com", ""]
    assert column(spark, urls, source.sanitize_referrer) == [
        "https://mail.google.com/a", "https://host/p", "", "https://a.com/", "", "HTTP://x.com/", ""
    ]


ADDRESSES = [
    "192.168.1.42", "255.255.255.255", "203.0.113.42", "not-an-ip", "", "01.2.3.4", "2001:db8:85a3:8d3:1319:8a2e:370:7348",
    "::1", "::", "1::", "::ffff:1.2.3.4", "0:0:1:2::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3", ":::", "1::2::3", "1:2:3:4:5:6:1.2.3.4",
]


def _anonymous(text_):
    try:
        address = ipaddress.ip_address(text_)
    except ValueError:
        return "0.0.0.0"
    bits = 24 if address.version == 4 else 48
    return str(ipaddress.ip_network(f"{text_}/{bits}", strict=False).network_address)


def test_anonymize_ip(spark):
    assert column(spark, ADDRESSES, ip.anonymize_ip) == [_anonymous(a) for a in ADDRESSES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.ip_addresses(v=6), min_size=40, max_size=40))
def test_ipv6_keys_match_the_standard_library(spark, addresses):
    texts = [str(a) for a in addresses] + [a.exploded for a in addresses]
    assert column(spark, texts, ip.ipv6_to_hex) == [format(int(a), "032x") for a in addresses] * 2
    assert column(spark, texts, ip.anonymize_ip) == [_anonymous(t) for t in texts]


def test_private_addresses(spark):
    got = column(spark, ["10.0.0.1", "172.31.0.1", "172.32.0.1", "8.8.8.8", "127.0.0.1", "fe80::1", "fd00::1", "2a00::1", "x", None], ip.is_private_ip)
    assert got == [True, True, False, False, True, True, True, False, True, True]


CIDRS = ["10.1.0.0/20", "20.0.0.5", "2001:db8::/33", "2001:db8:ffff::7", "0.0.0.0/31", "bad", "fe80::/10"]


def test_cidr_list_and_table_agree_with_the_standard_library(spark):
    tests = ["10.1.15.255", "10.1.16.0", "20.0.0.5", "20.0.0.6", "2001:db8:7fff::1", "2001:db8:8000::1", "2001:db8:ffff::7", "0.0.0.1", "febf::1", "fec0::1", "x"]
    nets = [ipaddress.ip_network(c) for c in CIDRS if c != "bad"]

    def inside(t):
        try:
            return any(ipaddress.ip_address(t) in n for n in nets if n.version == ipaddress.ip_address(t).version)
        except ValueError:
            return False

    expected = {t: inside(t) for t in tests}
    hits = spark.createDataFrame([(t,) for t in tests], "ip string")
    listed = admission.exclude_ips(hits, CIDRS)
    table = admission.exclude_ips(hits, spark.createDataFrame([(c,) for c in CIDRS], "cidr string"))
    assert {r.ip: r.ip_excluded for r in listed.collect()} == expected
    assert {r.ip: r.ip_excluded for r in table.collect()} == expected


def test_places_of_ranges_that_overlap(spark):
    """Of ranges around an address the one that starts last counts; a range of all addresses and one that ends early don't hide others."""
    ranges = spark.createDataFrame(
        [
            ("20.0.0.0", "20.3.255.255", "AA"), ("20.1.0.0", "20.1.255.255", "AB"), ("20.1.7.0", "20.1.7.9", "AC"), ("2a00::", "2a00:ff::ffff", "BB"),
            ("10.0.0.0", "10.255.255.255", "ZZ"), ("0.0.0.0", "255.255.255.255", "YY"), ("20.0.0.0", "20.0.0.255", "AD"),
        ],
        "ip_from string, ip_to string, country_code string",
    )
    for c in enrich.GEO_COLUMNS[1:]:
        ranges = ranges.withColumn(c, F.lit("x"))
    expected = {
        "20.2.9.9": "AA", "20.4.0.0": "YY", "2a00:1::5": "BB", "10.1.1.1": "", "2a00:ff:1::": "", "bad": "", "20.1.7.5": "AC", "20.1.7.10": "AB", "20.2.0.0": "AA",
        "20.0.0.9": "AD", "20.0.1.0": "AA", "1.1.1.1": "YY",
    }
    hits = spark.createDataFrame([(t,) for t in expected], "ip string")
    found = enrich.geo_enrich(hits, ranges)
    assert {r.ip: r.country_code for r in found.collect()} == expected


def test_devices(spark):
    agents = [
        "Mozilla/5.0 (iPad; CPU OS 16_6) Version/16.6 Mobile/15E Safari/604.1", "Mozilla/5.0 (iPad; CPU OS 16_6) Version/16.6 Safari/604.1",
        "Mozilla/5.0 (Linux; Android 13) Chrome/118.0 Safari/537.36", "x Chrome/120.0 Safari/537.36 Edg/120.5", "", "curl/8",
    ]
    assert column(spark, agents, device.device_type) == ["Mobile", "Tablet", "Tablet", "Desktop", "", "Desktop"]
    assert column(spark, agents, device.browser_name) == ["Safari", "Safari", "Chrome", "Edge", "", ""]
    assert column(spark, agents, device.browser_version) == ["16.6", "16.6", "118.0", "120.5", "", ""]


def test_event_names_and_props(spark):
    assert column(spark, [" Sign Up! ", "__a--b__", "!!", "é" * 3, "x" * 150], lambda c: text.clean_event_name(c, 100)) == [
        "Sign_Up", "a_b", None, None, "x" * 100,
    ]
    assert column(spark, ["x" * 150], text.clean_event_name) == ["x" * 150]
    props = [
        '{"a":1,"b":"<b>x</b> ","c":true,"d":null,"e":1.5,"f":"late"}', '{"":1,"b":{"x":1},"c":[1]}', "bad", None,
        '{"z":"1","a":2,"<i>z</i>":3}', '{"q":"say \\"hi\\"","n":12345678901234567890}',
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(props)], "i int, p string")
    got = [r.o for r in text.with_clean_props(df, "p", "o", 5).orderBy("i").collect()]
    assert got == ['{"a":1,"b":"x","e":1.5}', None, None, None, '{"a":2,"z":3}', '{"q":"say \\"hi\\"","n":12345678901234567890}']


def test_signatures_and_hashes(spark):
    for secret in (b"short", b"k" * 100):
        expected = hmac.new(secret, b"page|5", hashlib.sha256).hexdigest()
        assert spark.range(1).select(identity.hmac_sha256(F.lit("page|5"), secret)).first()[0] == expected
    got = spark.range(1).select(identity.visitor_hash(F.lit(b"\x01" * 16), F.lit("1.2.3.0"), F.lit("ua"), "https://a.b")).first()[0]
    assert bytes(got) == hashlib.sha256(b"\x01" * 16 + b"1.2.3.0uahttps://a.b").digest()[:8]
    assert column(spark, ["/a", "/ü"], source.uri_hash) == [zlib.crc32(b"/a"), zlib.crc32("/ü".encode())]


def test_all_props_are_kept(spark):
    df = spark.createDataFrame([('{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6,"g":7,"h":8,"<i>a</i>":9}',)], "p string")
    assert text.with_clean_props(df, "p", "o").first().o == '{"b":2,"c":3,"d":4,"e":5,"f":6,"g":7,"h":8,"a":9}'


def test_null_keys_have_null_ids(spark):
    df = spark.createDataFrame([(None, None), ("a", None), ("a", "b")], "x string, y string")
    got = df.select(identity.key_id(F.col("x")).alias("one"), identity.key_id(F.col("x"), F.col("y")).alias("two")).collect()
    assert got[0].one is None and got[0].two is None
    assert got[1].one == got[2].one is not None and got[1].two != got[2].two


def test_uri_checksums_of_given_tables(spark, small):
    from catalog.queries import QUERIES

    for name in ("C16_resolve_uri", "D10_resource_uris"):
        rows = QUERIES[name](spark, small).collect()
        assert rows and all(r.uri_hash == zlib.crc32(r.uri.encode()) for r in rows)


def test_payload_order(spark):
    ok = '{"resource_type":"page","signature":"s","page_url":"/a"}'
    rows = [
        ("text/html", "x" * 9000, 415), ("text/plain;charset=utf-8", "x" * 8193, 413), ("application/json", "5", 400), ("text/plain", "[]", 400),
        ("text/plain", ok.replace("page_url", "nope"), 400), ("text/plain", ok.replace("/a", "https://evil.test/"), 400),
        ("text/plain", ok.replace("/a", "https://shop.test/"), None), ("text/plain", ok, None), ("text/plain", '{"resource_type":"page"}', 400),
        ("text/plain", '{"resource_type":"a","resource_type":"b","signature":"s"}', 400), (None, ok, 415), ("text/plain", None, 400),
    ]
    df = spark.createDataFrame([(i, c, b) for i, (c, b, _) in enumerate(rows)], "i int, content_type string, body string")
    got = admission.validate_payload(df, ["shop.test"]).orderBy("i").select("reject_status").collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_wildcards(spark):
    assert column(spark, ["/Admin/x", "/a.b", "/axb", "/q"], lambda c: text.match_any_wildcard(c, ["/admin/*", "/a.b", " "])) == [True, True, False, False]
    assert column(spark, ["/a"], lambda c: text.match_any_wildcard(c, [])) == [False]


def test_dates_must_be_iso(spark):
    with pytest.raises(ValueError):
        admission.date_range(spark.range(1).select(F.current_timestamp().alias("t")), "t", "2024-1-1", "2024-01-02")


def test_bot_fragments_in_any_case(spark):
    """The plain search ahead of the pattern loses none of its matches and adds none."""
    from footfall import fixed_values as fv
    from footfall.functions import device

    forms = lambda f: (f, f.upper(), f"x{f.title()}y", f"\u00e9{f.upper()}\u0130", f[:-1], f"{f[:2]} {f[2:]}", f.replace("k", "\u212a").replace("i", "\u0130"))
    rows = [(v,) for f in fv.BOT_FRAGMENTS for v in forms(f)] + [(None,), ("",), ("0",), ("Cubot",)]
    agents, u = spark.createDataFrame(rows, "u string"), F.col("u")
    pattern = "(?i)" + "|".join(f.replace(".", "\\.") for f in fv.BOT_FRAGMENTS)
    expected = u.isNull() | u.isin("", "0") | u.rlike(pattern)
    assert agents.where(expected).count() > 3 * len(fv.BOT_FRAGMENTS)
    assert agents.where(~expected.eqNullSafe(device.is_bot(u))).count() == 0
