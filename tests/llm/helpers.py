"""Small frames and brute-force versions for the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and white-space texts, short and long texts, repeated rows, ties.
ODD_TEXTS = [None, "", " \t\n", "one", "one two three four", "ONE two Three four five", "one two three four five",
             "Ünï cödé — ÄÖÜ ß 東京 🙂 " * 12, "x" * 3000, "the " * 400, "a b c d e f g h i j k l m n o p " * 30, "nul\x00in text"]


def odd_documents(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one", "en", "s0", 3), (40, ODD_TEXTS[10], None, "s1", 9), (41, ODD_TEXTS[10] + "q", "en", "s1", 9), (None, "one", "en", "s2", 3)]
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    import re
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(nodes, links):
    """Smallest reachable node per node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
