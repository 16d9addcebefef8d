"""Labelled findings for the secret scan: strings in context, with whether they are a secret.

No given table labels such findings, so these are put together by a seeded draw: secrets of
usual makes in usual places, and what scanners take for them by mistake.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

HEX, DIGITS = "0123456789abcdef", "0123456789"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM, BASE64 = LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/"
# Fixed forms of well-known keys: prefix, alphabet, length.
KEY_FORMS = [("AKIA", UPPER + DIGITS, 16), ("ghp_", ALNUM, 36), ("sk_live_", ALNUM, 24), ("xoxb-", DIGITS + LOWER, 40),
             ("AIza", ALNUM + "_-", 35), ("glpat-", ALNUM, 20), ("npm_", ALNUM, 36)]
ASSIGNED = ['token = "{}"', "token: {}", 'api_key = "{}"', "API_KEY={}", '"client_secret": "{}"', "secret = '{}'", 'auth_token="{}"',
            "access_key: {}", "Authorization: Bearer {}", "credentials = {}", 'TOKEN = "{}"', "apikey={}", 'private_key = "{}"']
PASSWORDS = ['password = "{}"', "passwd: {}", "DB_PASSWORD={}", "pwd='{}'", '"password": "{}"']
# Values inside addresses and behind prefixes.
IN_QUERY = ["https://api.site.com/v1?api_key={}", "https://example.org/data?lang=en&access_token={}&page=2", "http://host.net/login?secret={}",
            "env:API_KEY={}", "config:auth_token={}", "https://www.example.com/cb#id_token={}", "env:TOKEN={}"]
IN_USER = ["postgres://admin:{}@db.host/app", "https://user:{}@example.com/repo.git", "mysql://root:{}@localhost:3306/shop",
           "redis://default:{}@cache.example.net:6379", "mongodb://app:{}@mongo.host/data", "amqp://worker:{}@queue.host:5672"]
PLAIN_QUERY = ["https://shop.example.com/item?id={}", "https://example.org/list?page=2&order={}", "https://cdn.example.net/app.js?v={}&lang=en",
               "https://example.com/commit?sha={}", "log:request_id={}", "mail:{}@example.com", "https://www.site.com/search?q={}&page=1", "build:version={}"]
HASHES = ["commit {}", "sha1: {}", "sha256 = {}", 'checksum = "{}"', "git checkout {}", "md5 {}", "digest: {}", "etag={}",
          "https://example.com/files/{}.html", "/objects/{}/data", 'revision "{}"', 'hash = "{}"', "fingerprint {}", "build {}"]
NAMES = ["id: {}", 'uuid = "{}"', "request {}", "session-id: {}", "/users/{}/edit", "order {}", "{}", "trace {}"]
PLACEHOLDERS = ["YOUR_API_KEY_HERE1", "your-token-goes-here-123", "xxxxxxxxxxxxxxxx1234", "example_token_12345", "changeme12345",
                "insert_secret_here_1", "dummy-key-000000000", "test_password_123", "<your_token_1>", "0000000000000000000000", "123456789012",
                "sample_secret_2024", "placeholder_1234", "REDACTED_12345678", "abcdefgh12345678", "os.environ.TOKEN1", "process.env.API_KEY_2"]
PLACES = ["/usr/lib/python3.13/site-packages/{}.py", "src/main/java/{}1.java", "C:/Users/{}/file_01.txt", "https://www.example.org/{}/page-2.html",
          "www.example.com/{}?page=2", "../assets/{}-v2.min.js", "s3://bucket/{}/part-00001.parquet"]


def labelled_findings(count: int, words: list[str], seed: int = 11) -> Iterator[tuple[str, int, int, int]]:
    """``count`` rows (text, start, end, is secret); ``words`` make up the text around."""
    pick = random.Random(seed)
    words = words or ["word"]

    def chars(alphabet: str, n: int) -> str:
        return "".join(pick.choices(alphabet, k=n))

    def prose(n: int) -> str:
        return " ".join(pick.choices(words, k=n))

    def joined() -> str:
        return pick.choice("_-.").join(pick.choices(words, k=pick.randint(2, 4))) + chars(DIGITS, pick.randint(1, 4))

    def secret() -> tuple[str, str]:
        kind = pick.random()
        if pick.random() < 0.1:
            return pick.choice(IN_USER), chars(ALNUM + "!*_-", pick.randint(8, 24))
        if pick.random() < 0.12:
            prefix, alphabet, n = pick.choice([*KEY_FORMS, ("", HEX, 40), ("", ALNUM, 32)])
            return pick.choice(IN_QUERY), prefix + chars(alphabet, n)
        if kind < 0.35:
            return pick.choice(ASSIGNED), chars(HEX, pick.choice([32, 40, 40, 48, 64]))
        if kind < 0.6:
            return pick.choice(ASSIGNED), chars(pick.choice([BASE64, ALNUM, UPPER + DIGITS]), pick.randint(16, 64)) + pick.choice(["", "", "="])
        if kind < 0.8:
            prefix, alphabet, n = pick.choice(KEY_FORMS)
            return pick.choice([*ASSIGNED, "{}", "{}"]), prefix + chars(alphabet, n)
        if kind < 0.9:
            return pick.choice([*ASSIGNED[8:9], "{}", 'jwt = "{}"']), ".".join("eyJ" * (i < 2) + chars(ALNUM + "_-", pick.randint(20, 60)) for i in range(3))
        return pick.choice(PASSWORDS), chars(ALNUM + "!#%&*_", pick.randint(8, 20))

    def mistake() -> tuple[str, str]:
        kind = pick.random()
        if pick.random() < 0.12:
            return pick.choice(PLAIN_QUERY), pick.choice([joined(), chars(HEX, pick.choice([32, 40])), chars(DIGITS, pick.randint(8, 16)),
                                                          "-".join(chars(HEX, n) for n in (8, 4, 4, 4, 12))])
        if pick.random() < 0.08:
            return pick.choice([*IN_QUERY, *IN_USER]), pick.choice([*PLACEHOLDERS, joined()])
        if pick.random() < 0.08:
            form = pick.choice([*IN_QUERY, *IN_USER, *PLAIN_QUERY])
            return "{}", form.format(pick.choice([joined(), chars(DIGITS, pick.randint(4, 12)), pick.choice(words)]))
        if kind < 0.2:
            return pick.choice(HASHES), chars(HEX, pick.choice([32, 40, 64]))
        if kind < 0.3:
            return pick.choice([*NAMES, *HASHES]), "-".join(chars(HEX, n) for n in (8, 4, 4, 4, 12))
        if kind < 0.42:
            return pick.choice(["{}", "{}", "card {}", "ISBN {}", "no. {}", "account: {}"]), chars(DIGITS, pick.randint(12, 19))
        if kind < 0.5:
            return pick.choice(["{}", "at {}", "date: {}"]), f"20{chars(DIGITS, 2)}-0{chars('123456789', 1)}-1{chars(DIGITS, 1)}T1{chars(DIGITS, 1)}:2{chars(DIGITS, 1)}:3{chars(DIGITS, 1)}Z"
        if kind < 0.58:
            return pick.choice(["{}", "from {}", "mail: {}"]), f"{pick.choice(words)}.{chars(DIGITS, 2)}@mail{chars(DIGITS, 1)}.example.com"
        if kind < 0.63:
            return pick.choice(["{}", "server {}", "host: {}"]), ".".join(str(pick.randint(100, 255)) for _ in range(4))
        if kind < 0.75:
            return pick.choice([*ASSIGNED, *PASSWORDS]), pick.choice([*PLACEHOLDERS, joined(), pick.choice(PLACES).format(pick.choice(words))])
        if kind < 0.87:
            return "{}", pick.choice(PLACES).format(joined())
        return pick.choice(["{}", "see {}", "name: {}", 'title = "{}"']), joined()

    for i in range(count):
        form, value = secret() if i % 2 else mistake()
        before = prose(pick.randint(0, 6))
        head, _, tail = form.partition("{}")
        start = len(before) + bool(before) + len(head)
        text = f"{before}{' ' if before else ''}{head}{value}{tail} {prose(pick.randint(0, 5))}"
        if pick.random() < 0.1:
            text = text.upper()
            if len(text) < start + len(value):
                continue
        yield text, start, start + len(value), i % 2
