"""Secrets, encoding, templates, chat and archives: brute force, round trips, odd input."""

import base64
import hashlib
import random
import re
import string

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from quire.llm import bpe, chat, secrets, template, toxicity, warc
from tests.conftest import SF, same_as_duck

ODD = [(1, None, "x"), (2, "", "x"), (None, "token=abcdef1", None), (3, "token=abcdef1", "y"), (3, "token=abcdef1", "y"), (4, "a " * 60_000, "z")]
ODD_SCHEMA = "doc_id long, text string, spans string"  # an extra column that clashes with a result's


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- secrets ----------------------------------------------------------------------------


def brute_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = secrets.scan(docs, ("base_sha256",)).join(docs, "doc_id").collect()
    assert got and all(r.base_sha256 == sha(brute_base(r.text)) for r in got)
    r = random.Random(1)
    parts = ["token", "Secret", "api_key", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "0a1b2c3d4e5f", "é", "x", "\n"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert secrets.joined(secrets.base_spans(text)) == brute_base(text)


def test_random_strings_are_found_and_known_forms_are_not():
    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(2)
    find = lambda t: secrets.random_spans(t, [], c, secrets.MAX_CHARS_PER_TOKEN)
    keys = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(50)]
    assert sum(bool(find(f"the key {k} is")) for k in keys) >= 48
    harmless = [
        "d41d8cd98f00b204e9800998ecf8427e",
        "123e4567-e89b-12d3-a456-426614174000",
        "2024-01-01T00-00-00Z",
        "src/main/java/com/example/2024/index",
        "verantwortungsbewusstseinsbildung",
        "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=",
    ]
    assert [t for t in harmless if find(t)] == []


def test_random_strings_without_digits_are_found():
    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(3)
    find = lambda t: secrets.random_spans(t, [], c, secrets.MAX_CHARS_PER_TOKEN)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    for letters, least in ((string.ascii_letters, 50), (string.ascii_uppercase, 49), (string.ascii_lowercase, 44)):
        assert sum(bool(find(f"the key {draw(letters, 32)} is")) for _ in range(50)) >= least
    assert sum(find(k) == [(0, 3, 32)] for _ in range(50) if (k := f"live_{draw(string.ascii_letters, 24)}_42")) >= 48
    assert sum(bool(find("-".join(draw(string.ascii_letters, 8) for _ in range(4)))) for _ in range(50)) >= 45
    harmless = [
        "verantwortungsbewusstseinsbildung",
        "internationalization_and_localization",
        "MAX_NUMBER_OF_CONCURRENT_REQUESTS_PER_USER_10",
        "src/main/resources/internationalization/de",
        "getApplicationContextFactoryBean",
        "12345678901234567890123456789",
        "--------------------------------",
        "____________________/___________",
    ]
    assert [t for t in harmless if find(t)] == []


DIGEST = "sha512-" + base64.b64encode(hashlib.sha512(b"x").digest()).decode()
UUID = "123e4567-e89b-12d3-a456-426614174000"
ULID = "01ARZ3NDEKTSV4RRFFQ69G5FAV"


@pytest.mark.parametrize(
    "text",
    [
        f"id={UUID}", f"https://x.com/objects/{UUID}", f"https://x.com/objects/{UUID}/items/{UUID.upper()}?a=b", f"integrity={DIGEST}", f'integrity="{DIGEST}" x',
        f"request_id={UUID}&next=/home/page", f"build-{'0aF' * 13}1-linux", f"run={ULID}", f"logs/2024-01-01T00-00-00Z/worker/{UUID}.txt", "backup_20240101T101500Z_of_server",
        "test_x86_64_abi_v2_f32_and_arm64_builds", "session_identifier=none_of_the_above_is_given", "=" * 40, "a=" * 30, "/" * 40,
    ],
)
def test_known_forms_behind_keys_and_paths_are_no_findings(text):
    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert secrets.random_spans(text, secrets.base_spans(text), c, secrets.MAX_CHARS_PER_TOKEN) == []


def test_keys_behind_names_and_paths_are_found():
    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(12)
    find = lambda t: [t[s:e] for s, _, e in secrets.random_spans(t, [], c, secrets.MAX_CHARS_PER_TOKEN)]
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    good = {"value": 0, "path": 0, "blob": 0}
    for _ in range(100):
        k = draw(string.ascii_letters, 32)
        good["value"] += find(f"the_session_identifier_of_the_user={k}") == [k]
        good["path"] += find(f"https://example.com/the/long/path/of/documents/{k}/index") == [k]
        blob = base64.b64encode(r.randbytes(40)).decode()
        good["blob"] += find(f"value={blob} {UUID}") == [blob]
    assert min(good.values()) >= 97, good


def brute_random(text, known, encoder, most):
    """The same spans, worked out character by character with the tokenizer library."""
    least = 20
    alnum = set(string.ascii_letters + string.digits)
    sign = alnum | set("+/_=-")
    forms = [
        *(f"[0-9a-fA-F]{{{n}}}" for n in (32, 40, 56, 64, 96, 128)), "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "[0-7][0-9A-HJKMNP-TV-Z]{25}",
        "sha(1|256|384|512)[-=][A-Za-z0-9+/]{20,}={0,2}", "[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}[0-9Z+-]*)?", "[0-9]{8}T[0-9]{4,6}Z?",
    ]
    free = [c in sign for c in text]
    for s, _, e in known:
        free[s:e] = [False] * (e - s)
    at = 0
    while at < len(text):  # harmless forms, leftmost and longest first, inside whole runs
        ends = []
        if text[at] in sign and (at == 0 or text[at - 1] not in alnum):
            run_end = next((i for i in range(at, len(text)) if text[i] not in sign), len(text))
            begin = next((i + 1 for i in range(at - 1, -1, -1) if text[i] not in sign), 0)
            if run_end - begin >= least:
                ends = [e for f in forms for e in range(at + 1, run_end + 1) if re.fullmatch(f, text[at:e]) and (e == run_end or text[e] not in alnum)]
        if ends:
            free[at : max(ends)] = [False] * (max(ends) - at)
            at = max(ends)
        else:
            at += 1
    run = [False] * len(text)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) >= least:
            run[m.start() : m.end()] = [True] * len(m[0])
    free = [a and b for a, b in zip(free, run, strict=True)] + [False]
    out, start = [], None

    def named(part):
        pieces = re.split("[-_/]", part.removesuffix("/"))
        return len(pieces) > 1 and all(re.fullmatch("[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}[a-z]{0,2}", p) for p in pieces)

    def poor(part):
        if not any(c in string.ascii_letters for c in part):
            return False
        words = [w for w in re.split("[^A-Za-z]", part) if len(w) > 1] if named(part) else []
        if not words:
            return len(part) <= most * len(encoder.encode_ordinary(part))
        n = [len(encoder.encode_ordinary(w)) for w in words]
        return len("".join(words)) <= most * sum(n) or "/" not in part and any(len(w) >= least and len(w) <= most * k for w, k in zip(words, n, strict=True))

    for i, f in enumerate(free):
        if f and start is None:
            start = i
        if not f and start is not None:
            segment, j = text[start:i], 0
            if len(segment) >= least:
                body = segment.rstrip("=")
                for piece in body.split("="):
                    last = j + len(piece) == len(body)
                    part = segment[j:] if last and piece else piece
                    if len(part) >= least and piece:
                        k, inside = j, []
                        for name in part.split("/"):
                            if least <= len(name) < len(part) and poor(name):
                                inside.append((start + k, 3, start + k + len(name)))
                            k += len(name) + 1
                        if poor(part) and not (inside and named(part)):
                            out.append((start + j, 3, start + j + len(part)))
                        else:
                            out += inside
                    j += len(piece) + 1
            start = None
    return sorted(out)


def test_random_spans_equal_brute_force(reference):
    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(13)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    parts = ["=", "==", "/", "-", "_", "+", " ", ".", "token=", "id=", "com/objects/", "internationalization", "word", "é", "2024-01-01", "10", "x86", UUID, ULID, DIGEST, "0aF" * 13 + "1"]
    for _ in range(3000):
        keys = [draw(string.ascii_letters, r.choice([8, 24])), draw(string.ascii_letters + string.digits, r.choice([8, 24, 40])), draw("0123456789abcdef", r.choice([8, 24, 32, 40]))]
        text = "".join(r.choice([*parts, *keys]) for _ in range(r.randint(1, 9)))
        known = secrets.base_spans(text)
        assert secrets.random_spans(text, known, c, 1.9) == brute_random(text, known, reference, 1.9), text


def test_many_keys_take_linear_time():
    import time

    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(14)
    keys = [f"token={r.randbytes(9).hex()} {''.join(r.choice(string.ascii_letters) for _ in range(24))}\n" for _ in range(16_000)]
    took = []
    for n in (4_000, 16_000):
        text = "".join(keys[:n])
        began = time.process_time()
        spans = secrets.random_spans(text, secrets.base_spans(text), c, secrets.MAX_CHARS_PER_TOKEN)
        took.append(time.process_time() - began)
        assert len(spans) > 0.95 * n
    assert took[1] < 8 * took[0] + 1


def test_kept_columns_give_way_to_outputs(spark):
    df = spark.createDataFrame([(1, "token=abcdef1", "old", 5)], "doc_id long, text string, spans string, N_TOKENS long")
    got = secrets.scan(df, ("spans",), keep=("spans", "N_TOKENS"))
    assert got.columns == ["doc_id", "N_TOKENS", "spans"] and got.first().spans == "assign:0:13"
    assert bpe.encode(df, ("n_tokens",), keep=("spans", "N_TOKENS")).columns == ["doc_id", "spans", "n_tokens"]
    assert toxicity.score(df.withColumnRenamed("spans", "score"), toxicity.Model((), (), frozenset(), toxicity.UNTRAINED), ("doc_id", "score")).columns == ["doc_id", "score", "findings"]


def test_redaction_covers_overlaps():
    text = "a password=0123456789abcdef01234567 b"
    spans = secrets.base_spans(text)
    assert [s[1] for s in spans] == [0, 2]
    assert secrets.redacted(text, spans, "#") == "a # b"


def test_secrets_odd_input(spark):
    got = secrets.scan(spark.createDataFrame(ODD, ODD_SCHEMA)).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.n_assign) for r in got}
    assert by == {(1, 0), (2, 0), (None, 1), (3, 1), (4, 0)}
    assert [r.redacted for r in got if r.doc_id == 1] == [None]
    assert secrets.scan(spark.createDataFrame([], ODD_SCHEMA)).count() == 0


# ---- byte-pair encoding --------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in bpe.encode(docs, ("ids", "n_tokens", "decoded_sha256")).join(docs, "doc_id").collect():
        assert r.ids == reference.encode_ordinary(r.text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == sha(r.text)


def test_encoding_of_arbitrary_strings(reference):
    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice("aab thein  \n's1é中!\U0001f600") for _ in range(r.randint(0, 60)))
        ids = c.encode(text)
        assert ids == reference.encode_ordinary(text) and c.decode(ids) == text.encode()
    long = "ab" * 20_000  # one match, far too long for quadratic merging
    assert c.encode(long) == reference.encode_ordinary(long)


def test_rank_tree_finds_the_leftmost_minimum():
    r = random.Random(4)
    for n in (1, 2, 3, 7, 8, 9, 33):
        ranks = [r.randint(0, 5) for _ in range(n)]
        tree = bpe.RankTree(list(ranks))
        for _ in range(50):
            i = r.randrange(n)
            ranks[i] = r.choice([r.randint(0, 5), bpe.NONE])
            tree.put(i, ranks[i])
            least = min(ranks)
            assert tree.first_least() == (-1 if least == bpe.NONE else ranks.index(least))


def test_encoding_odd_input(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_TOKENS", 3)
    got = bpe.encode(spark.createDataFrame(ODD, ODD_SCHEMA), ("n_tokens", "ids_sha256")).collect()
    assert len(got) == len(ODD)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert {r.ids_sha256 for r in got if r.doc_id in (1, 2)} == {sha("")}
    assert bpe.encode(spark.createDataFrame([], ODD_SCHEMA)).count() == 0


# ---- templates and chat ----------------------------------------------------------------------


def render(source, **variables):
    return template.compile_template(source)(variables).text


def test_template_language():
    assert render("{{ 1 + 2 * 3 }}|{{ 'a' ~ 2 }}|{{ x.y }}|{{ z | default('d') }}", x={"y": 5}) == "7|a2|5|d"
    assert render("{% for i in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[1, 2, 3]) == "1,2,3"
    assert render("{% if a and b or c %}y{% elif d %}z{% else %}n{% endif %}", a=1, b=0, c=0, d=1) == "z"
    assert render("a  {#- c -#}  b{% set q = 'w' | upper %}{{ q }}") == "abW"


def test_constants_fold_and_dead_branches_go():
    assert template.fold(template.parse("{{ 1 + 1 }}{% if false %}x{% else %}y{% endif %}z")) == (template.Text("2yz"),)


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ xs }}", "{{ 'a' * 99 }}", "{{ x.y.z }}"])
def test_sandbox(bad):
    try:
        assert render(bad, x={"y": 1}, xs=[1]) == ""
    except template.TemplateError:
        pass
    for broken in ("{% if x %}", "{{ f(1) }}", "{% while x %}", "{{ a | nofilter }}", "{% for x %}{% endfor %}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(broken)


def test_tests_calls_parts_and_choices():
    source = "{{ 'a' if x not in xs else 'b' }}|{{ y is defined }}|{{ m.z is defined }}|{{ x is not none }}|{{ xs[1:] | length }}|{{ 'abc'[:2] }}|{{ m | tojson }}|{{ not x in xs }}"
    assert render(source, x=1, xs=[2, 3], m={"z": None}) == 'a|false|true|true|1|ab|{"z": null}|true'
    assert render("{% set ns = namespace(n=0) %}{% for i in range(1, 5) %}{% set ns.n = ns.n + i %}{% endfor %}{{ ns.n }}") == "10"
    assert render("{{ x if a else y if b else 'none of them' }}{{ q is string and 1 is number and xs is sequence }}", a=0, b=0, q="", xs=[]) == "none of themtrue"
    real = """{%- if messages[0]['role'] == 'system' -%}{% set system = messages[0]['content'] %}{% set rest = messages[1:] %}{%- else -%}{% set rest = messages %}{%- endif -%}
{%- for message in rest -%}{%- if (message['role'] == 'user') != (loop.index0 % 2 == 0) -%}{{ raise_exception('roles must alternate') }}{%- endif -%}
{%- if message['role'] == 'user' -%}{{ bos_token ~ '[INST] ' ~ (system ~ ' ' if loop.first and system is defined else '') ~ message['content'] | trim ~ ' [/INST]' }}{%- else -%}{% generation %}{{ ' ' ~ message['content'] ~ eos_token }}{% endgeneration %}{%- endif -%}{%- endfor -%}"""
    say = lambda *roles: [{"role": r, "content": r[0]} for r in roles]
    variables = {"bos_token": "<s>", "eos_token": "</s>"}
    assert render(real, messages=say("system", "user", "assistant", "user"), **variables) == "<s>[INST] s u [/INST] a</s><s>[INST] u [/INST]"
    with pytest.raises(template.TemplateError, match="alternate"):
        render(real, messages=say("user", "user"), **variables)


@pytest.mark.parametrize(
    "bad",
    [
        "{% set s = 'ab' %}{% for m in ms %}{% set s = s ~ s %}{% endfor %}{{ s | length }}",
        "{% set s = 'ab' %}{% for m in ms %}{% set s = s + s %}{% endfor %}",
        "{% set ns = namespace(s='ab') %}{% for m in ms %}{% set ns.s = [ns.s, ns.s] | join %}{% endfor %}",
        "{% set ns = namespace(s='ab') %}{% for m in ms %}{% set ns.s = ns.s ~ ns.s %}{% endfor %}",
        "{% set x = 9 %}{% for m in ms %}{% set x = x * x %}{% endfor %}{{ x }}",
        "{% for i in range(99999999999) %}{% endfor %}",
        "{% for a in ms %}{% for b in ms %}{% for c in ms %}{% for d in ms %}{% for e in ms %}{% endfor %}{% endfor %}{% endfor %}{% endfor %}{% endfor %}",
        "{{ raise_exception('no') }}", "{{ 1 // 0 }}", "{{ 1 < 'a' }}", "{{ 5 | length }}", "{{ ms.append(1) }}", "{{ open('x') }}", "{% set ms.x = 1 %}", "{{ 'a' * 9 }}",
    ],
)
def test_what_a_rendering_makes_is_bounded(bad):
    with pytest.raises(template.TemplateError):
        render(bad, ms=list(range(60)))


def test_the_allowance_grows_with_the_input():
    big = [{"role": "user", "text": "x" * 1_000_000}] * 40
    out = template.compile_template(chat.CHAT_TEMPLATE)({"messages": big})
    assert out.length > 40_000_000


def test_control_strings_are_escaped_reversibly():
    r = random.Random(5)
    for _ in range(5000):
        s = "".join(r.choice(["<", "s", ">", "/", "\\", "[", "INST", "]", "</s>", "[INST]", "a"]) for _ in range(r.randint(0, 12)))
        e = template.escape_controls(s)
        assert template.unescape_controls(e) == s and not any(c in e for c in template.CONTROLS)
        out = template.compile_template(chat.CHAT_TEMPLATE)({"messages": [{"role": "user", "text": s}, {"role": "assistant", "text": s}, {"role": s, "text": "x"}]})
        assert chat.read_turns(out.text) == [("user", s), ("assistant", s), (s, "x")]


def test_conversations_equal_brute_force(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    by = {}
    for c, *rest in sorted(rows):
        by.setdefault(c, []).append(rest)
    got = {r.conv_id: r for r in chat.op3_chat_format(spark, SF).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
        assert got[c].turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, role, t in turns))


def test_conversations_odd_input(spark):
    schema = "conv_id long, turn long, role string, text string, n_turns string"
    rows = [(1, 2, "user", None, "x"), (1, None, None, "a", None), (1, 2, "user", None, "x"), (None, 1, "assistant", "", "q")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].turns_sha256 == sha("\na\nuser\n\nuser\n\n") and got[1].n_turns == 3
    assert got[None].loss_chars == 0 and got[None].n_turns == 1
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


# ---- archives ------------------------------------------------------------------------------------


def test_archives_equal_sql(spark):
    same_as_duck(warc.op2_warc(spark, SF), warc.ORACLE)


def test_archives_odd_input(spark, tmp_path):
    big = "<p>ü\r\n\r\nWARC/1.1\r\n</p>" * 60
    rows = [(1, "http://a/\r\nx", big, 1), (9, None, big, 1), (9, "http://b", big, 1), (None, "http://c", big, 1), (3, "u", None, 1), (4, "v", "same", 1), (5, "w", "same", 1)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long"), path)
    recs = warc.read_archives(spark, path).cache()
    assert recs.count() == 3 * len(rows)
    got = warc.assemble(recs).collect()
    assert len(got) == len(rows) and all(len(r.requests) == 1 and len(r.metadata) == 1 for r in got)
    page = {r.record_id: r.page_id for r in got}
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to and page[r.refers_to])) for r in got) == sorted(
        [("1", "revisit", "9"), ("9", "response", "None"), ("9", "response", "None"), ("None", "revisit", "9"), ("3", "response", "None"), ("4", "response", "None"), ("5", "response", "None")]
    )
    whole = [r for r in got if r.page_id == 9][0]
    assert bytes(whole.block).partition(b"\r\n\r\n")[2].decode() == big and bytes(whole.block)[whole.payload_start :].decode() == big
    assert {r.payload_digest for r in got if r.page_id == 3} == {hashlib.sha1(b"").hexdigest()}
    empty = str(tmp_path / "e")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.assemble(warc.read_archives(spark, empty)).count() == 0


def test_archives_are_members_that_split(spark, tmp_path):
    import gzip
    import zlib

    r = random.Random(18)
    rows = [(i, f"http://h/{i}", "".join(r.choice("abcde<>\r\n") for _ in range(r.choice([0, 10, 5000])))) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages.coalesce(1), path, records_per_file=400)
    parts = sorted((tmp_path / "w").glob("part-*"))
    assert len(parts) == 3  # of 900 records
    for part in parts:
        data, members = part.read_bytes(), 0
        records = list(warc.parse_records(gzip.GzipFile(fileobj=open(part, "rb"))))
        while data:
            d = zlib.decompressobj(31)
            text = d.decompress(data)
            assert text == b"" or (text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Record-ID") == 1 and text.endswith(b"\r\n\r\n"))
            members += text != b""
            data = d.unused_data
        assert members == len(records) <= 400
    whole = sorted(x.record_id for x in warc.read_archives(spark, path).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pieces = warc.read_archives(spark, path)
        assert pieces.rdd.getNumPartitions() > 5 and sorted(x.record_id for x in pieces.collect()) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_member_holds_the_separator():
    stored = b"".join(bytes([i]) for i in range(256)) + warc.MEMBER_END * 3
    import gzip

    for record in (stored, random.Random(19).randbytes(5000) + warc.MEMBER_END):
        made = warc.member(record)
        assert warc.MEMBER_END not in made and gzip.decompress(made) == record + b"\r\n\r\n"
    assert gzip.decompress(warc.MEMBER_END) == b""


def test_foreign_archives_are_read(spark, tmp_path):
    import gzip

    record = lambda i: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n".encode()
    (tmp_path / "part-a.warc").write_bytes(record(1) + record(2))
    (tmp_path / "part-b.warc").write_bytes(gzip.compress(record(3)) + gzip.compress(record(4)))
    (tmp_path / "part-c.warc.gz").write_bytes(gzip.compress(record(5)) + gzip.compress(record(6)))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in got) == [f"<urn:{i}>" for i in range(1, 7)] and {r.payload_bytes for r in got} == {3}


def test_transactions_join_either_way(spark):
    cols = "record_id string, record_type string, concurrent_to array<string>, target_uri string, page_id long, refers_to string, payload_bytes long, payload_digest string, payload_start int, block binary"
    none = (None,) * 7
    rows = [("r1", "response", ["q1"], *none), ("q1", "request", [], *none), ("m1", "metadata", ["q1"], *none), ("m2", "metadata", ["r1"], *none), ("m3", "metadata", ["lost"], *none), ("r2", "revisit", [], *none)]
    got = {r.record_id: r for r in warc.assemble(spark.createDataFrame(rows, cols)).collect()}
    assert [x.record_id for x in got["r1"].requests] == ["q1"] and [x.record_id for x in got["r1"].metadata] == ["m1", "m2"]
    assert got["r2"].requests == [] and set(got) == {"r1", "r2"}
