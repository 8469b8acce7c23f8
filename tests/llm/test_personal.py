import pytest

from recollect.llm import pii

NAMES = pii.NameParts(["Petra Silvanesh", "Oswin Stavrosky", "Ilona Carradune ", None, "Windrow", ""])


def kinds(text):
    return {(text[s.start : s.end], s.kind) for s in pii.find(text, NAMES)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Reach me at JO.X@KILN.EXAMPLE if it stalls", {("JO.X@KILN.EXAMPLE", "email")}),
        ("cc mailto:a_b@corp.millrace.test now", {("a_b@corp.millrace.test", "email")}),
        ("write to jane dot doe at example dot org now", {("jane dot doe at example dot org", "email")}),
        ("x [at] post [dot] overlook [dot] example", {("x [at] post [dot] overlook [dot] example", "email")}),
        ("yachterveld @ lattice.test.", {("yachterveld @ lattice.test", "email")}),
        ("邮箱是 a(at)b.test，有问题", {("a(at)b.test", "email")}),
        ("ｊｏｅ＠ｋｉｌｎ．ｅｘａｍｐｌｅ", {("ｊｏｅ＠ｋｉｌｎ．ｅｘａｍｐｌｅ", "email")}),
        ("Clone git@code.x.example:team/a.git and loom@4.2.2, @retry", set()),
        ("Call +15515550152 or (862) 555-0122 or 555-0191 ext. 99", {("+15515550152", "phone"), ("(862) 555-0122", "phone"), ("555-0191 ext. 99", "phone")}),
        ("tel +49 (0)30 555 73 61 and +86 10 5550 8628", {("+49 (0)30 555 73 61", "phone"), ("+86 10 5550 8628", "phone")}),
        ("call five five five, zero one two three four nine.", {("five five five, zero one two three four nine", "phone")}),
        ("Build 719.641.8249 is green. Epoch 1745545409. 会话编号 2986630940 已归档。", set()),
        ("Order ref 807-33-321, Ports 5361-5528, Host 192.0.2.33, 5.3.21, KV-9521", set()),
        ("(993-24-7093) QQ 49 32 69 A, XK7378718; 99146119910227136X", {("993-24-7093", "id_number"), ("QQ 49 32 69 A", "id_number"), ("XK7378718", "id_number"), ("99146119910227136X", "id_number")}),
        ("I moved to Flat 16, 385 Easterby Lane, Northwick.", {("Flat 16, 385 Easterby Lane, Northwick", "address")}),
        ("收件地址：云岚市石榴街91号9单元121室。", {("云岚市石榴街91号9单元121室", "address")}),
        ("Quillmoorweg 25, 01563 Northwick", {("Quillmoorweg 25, 01563 Northwick", "address")}),
        ("There are 33 Lane Merge jobs and 6 Street View tiles in the queue.", set()),
        ("Met petra silvanesh and Dr. Unknown at the review", {("petra silvanesh", "name"), ("Dr. Unknown", "name")}),
        ("Signed-off: STAVROSKY, OSWIN", {("STAVROSKY, OSWIN", "name")}),
        ("My name is new person and I moved", {("new person", "name")}),
        ("请联系司徒溯霁，电话", {("司徒溯霁", "name")}),
        ("昨天和端木棠一起确认了", {("端木棠", "name")}),
        ("Project Marlow and Service Atlas share one vault.", set()),
        ("to petra.silvanesh@kiln.example", {("petra.silvanesh@kiln.example", "email")}),
        ("", set()),
        ("   \n", set()),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


def test_placeholders_keep_all_else():
    text = "Hi — write to p​etra@kiln.example，or İ. Ok.\n\tEnd"
    assert pii.redact_text(text, NAMES) == "Hi — write to [EMAIL]，or İ. Ok.\n\tEnd"
    assert pii.redact_text("no one here", NAMES) == "no one here"


def test_offsets_of_every_step():
    text = "ａ​b five five five five five five five"
    m = pii.normalise(text)
    assert m.text == "ab 5555555" and m.span(0, 1) == (0, 1) and m.span(1, 2) == (2, 3)
    assert text[slice(*m.span(3, 10))] == "five five five five five five five"


def test_long_text():
    text = "word " * 200_000 + "a@b.test"
    assert [s.kind for s in pii.find(text, NAMES)] == ["email"]


def test_over_tables(spark):
    ev = spark.createDataFrame([(1, "a@b.test", 9), (2, None, 9), (3, "", 9), (None, "a@b.test", 9), (4, " ", 9)], "id bigint, content string, rel int")
    so = spark.createDataFrame([("s", "Call +15515550152"), ("s", "Call +15515550152"), (None, "x")], "id string, content string")
    cl = spark.createDataFrame([([("e1", "Petra Silvanesh, a@b.test"), ("e2", None)],), (None,), ([],)], "evidence array<struct<id:string,text:string>>")
    texts = pii.texts(ev, so, cl)
    got = {tuple(r) for r in pii.found_kinds(texts, ["Petra Silvanesh"]).collect()}
    assert got == {("agent_events", "1", "email"), ("vault_sources", "s", "phone"), ("vault_claims.evidence", "e1", "name"), ("vault_claims.evidence", "e1", "email")}
    assert pii.found_kinds(texts.limit(0), []).count() == 0
    red = {r.row_key: (r.text, r.found) for r in pii.redact(texts, ["rel", "row_key"], "text", []).collect()}
    assert red["1"] == ("[EMAIL]", 1) and red["4"] == (" ", 0)


def test_known_persons(spark):
    e = spark.createDataFrame([("Petra Silvanesh ", "person"), ("Ilona X. Carradune", None), ("Windrow Labs", "organization"), ("v1.2", None), (None, "person"), ("warm cache", "named")], "name string, entity_type string")
    assert pii.known_persons(e) == ["Ilona X. Carradune", "Petra Silvanesh"]


@pytest.mark.parametrize("text", ["The change was reviewed by Nora Vantongeren on Friday.", "Nora Vantongeren suggested a longer timeout.", "Dear Nora Vantongeren, the run is done.", "We handed the relay over to staging and it was escalated to Nora Vantongeren."])
def test_names_in_common_contexts(text):
    names = pii.NameParts([])
    spans = [text[s.start : s.end] if hasattr(s, "start") else text[s[0] : s[1]] for s in pii.find(text, names)]
    assert any("Nora Vantongeren" in x for x in spans)


@pytest.mark.parametrize("text", ["According to the timeline, it ran.", "Dear all, the run is done.", "We met the limit. It was approved by the lint step."])
def test_contexts_without_a_name(text):
    assert not pii.find(text, pii.NameParts([]))
