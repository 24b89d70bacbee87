from sitegauge.functions import address, contacts, evidence, text, urls


def test_html_to_text(one):
    F = one.F
    html = F.lit("<p>A&amp;B &#169; &#1110;<script>x<y</script><b>c</b>&nbsp;d &lt;e&gt;</p><noscript>no</noscript>")
    assert one(text.html_to_text(html)) == "A&B © і c d <e>"


def test_fingerprint_ignores_scripts_comments_and_blanks(one):
    F = one.F
    a = text.fingerprint(F.lit("<p>x  y</p><script>1</script><!-- a -->"))
    b = text.fingerprint(F.lit("<p>x y</p><script>2</script><!-- b -->"))
    c = text.fingerprint(F.lit("<p>x z</p>"))
    va, vb, vc = one(a, b, c)
    assert va == vb != vc


def test_fingerprint_sees_the_end_of_a_long_page(one):
    F = one.F
    long = "w " * 30_000
    va, vb = one(text.fingerprint(F.lit(long + "a")), text.fingerprint(F.lit(long + "b")))
    assert va != vb


def test_spelling_variants_share_a_key(one):
    F = one.F
    groups = [["Blimii", "Blimiy", "Blimy", "Блімій"], ["Khorbak", "Horbak"], ["Juriqa", "Yuriqa"], ["Zoff", "Zov"],
              ["Élan", "elan", "ELAN"], ["Bički", "Bichki"]]
    for group in groups:
        keys = one(*[text.name_key(F.lit(w)) for w in group])
        assert len(set(keys)) == 1, (group, keys)


def test_different_orthographies_stay_apart(one):
    F = one.F
    a, b = one(text.name_key(F.lit("Blonarczuk")), text.name_key(F.lit("Blonarchuk")))
    assert a != b


def test_transliteration_of_multi_letter_signs(one):
    F = one.F
    assert one(text.transliterate(F.lit("Щука жаба її ґава"))) == "shchuka zhaba ii gava"


def test_plural(one):
    F = one.F
    words = one(*[text.plural(F.lit(n), "a", "b", "c") for n in (1, 2, 5, 11, 21, 22, 112, 100)])
    assert words == ("a", "b", "c", "c", "a", "b", "c", "c")


def test_round_half_up_goes_to_plus_infinity(one):
    F = one.F
    assert one(*[text.round_half_up(F.lit(x)) for x in (2.5, -2.5, 2.4)]) == (3, -2, 2)


def test_host_and_url(one):
    F = one.F
    assert one(*[urls.host_of(F.lit(u)) for u in ("https://www.A.com:80/x", "nonsense", "http://u@b.org/?q")]) == ("a.com", "", "b.org")
    assert one(*[urls.safe_url(F.lit(u)) for u in ("a.com", "http://a.com", "ftp://a")]) == ("https://a.com", "http://a.com", "https://ftp://a")


def test_relative_links(one):
    F = one.F
    base = F.lit("https://a.com/d/e.html?x=1")
    got = one(*[urls.resolve(F.lit(h), base) for h in ("/p", "q", "?y=2", "//b.org/z", "https://c.net/")])
    assert got == ("https://a.com/p", "https://a.com/d/q", "https://a.com/d/e.html?y=2", "https://b.org/z", "https://c.net/")


def test_addresses(one):
    F = one.F
    good = ("1 W St, Chicago, IL 60622", "x, Reno, NV", "5 A, B, NY 11235-1234", "anything, USA")
    bad = ("1 King St, Toronto, ON M5V", "x, ZZ 12345", "", None)
    assert all(one(*[address.is_us_address(F.lit(a)) for a in good]))
    assert not any(one(*[address.is_us_address(F.lit(a)) for a in bad]))
    a = F.lit(good[0])
    assert one(address.city_of(a), address.state_of(a)) == ("Chicago", "IL")


def test_location_label_names_both_places_when_they_differ(one):
    F = one.F
    got = one(
        address.location_label(F.lit("Reno"), F.lit("NV"), F.lit(None).cast("string"), F.lit("chicago")),
        address.location_label(F.lit("Chicago"), F.lit("IL"), F.lit(None).cast("string"), F.lit("chicago")),
    )
    assert got == ("Reno, NV  (знайдено через chicago)", "Chicago, IL")


def test_emails(one):
    F = one.F
    html = F.lit('x <a href="mailto:Zed@firm.com?subject=1">m</a> help@firm.com logo@2x.png info@firm.com a@example.com noreply@firm.com')
    assert one(contacts.best_emails(contacts.emails_found(html))) == ["info@firm.com", "help@firm.com", "zed@firm.com", "noreply@firm.com"]


def test_spelled_out_address_only_without_a_plain_one(one):
    F = one.F
    got = one(
        contacts.emails_found(F.lit("write to joe (at) firm (dot) com")),
        contacts.emails_found(F.lit("joe (at) firm (dot) com or a@b.org")),
        contacts.emails_found(F.lit("meet me at home. dot")),
    )
    assert got == (["joe@firm.com"], ["a@b.org"], [])


def test_obfuscated_address(one):
    F = one.F
    plain, key = "me@firm.com", 0x5A
    coded = f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in plain)
    assert one(contacts.emails_found(F.lit(f'<a data-cfemail="{coded}">'))) == [plain]


def test_every_address_of_a_long_text_is_seen(one):
    F = one.F
    body = " ".join(f"u{i}@firm.com" for i in range(60)) + " " + "w " * 100_000 + "office@firm.com"
    assert one(contacts.best_emails(contacts.emails_found(F.lit(body))))[0] == "office@firm.com"


def test_social_profile_is_not_a_share_button(one):
    F = one.F
    html = F.lit('<a href="https://facebook.com/tr?id=1"><a href="https://www.facebook.com/realpage"><a href="https://t.me/shop">')
    assert one(contacts.social_profiles(html)) == {"facebook": "https://www.facebook.com/realpage", "telegram": "https://t.me/shop"}


def test_evidence_lists(one):
    F = one.F
    items = evidence.evidence(
        evidence.item("a", 18, F.lit("A")), evidence.item("b", 32, F.lit("B")), evidence.item("c", 32, F.lit("C"))
    )
    kept = one(evidence.strongest_counts(items))
    assert [(e["signal"], e["weight"]) for e in kept] == [("b", 32), ("a", 0), ("c", 0)]
    assert one(evidence.total(items)) == 82
    assert one(evidence.as_text(evidence.strongest_counts(items))) == "B (+32); A; C"
    assert one(evidence.total(evidence.empty())) == 0 and one(evidence.strongest_counts(evidence.empty())) == []
