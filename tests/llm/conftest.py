import re

import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]
