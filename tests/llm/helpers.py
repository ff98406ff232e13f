import re

SF = "/root/testdata/sf0.001"
CLASHES = "block long, bucket long, row string, tile int, band string, n long, words string, at int, of string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def docs(spark, rows, clash=True):
    """rows: (doc_id, text[, source]); further columns carry names that operators use inside."""
    data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        for c in CLASHES.split(", "):
            name, kind = c.split()
            df = df.selectExpr("*", f"cast(7 as {kind}) as {name}")
    return df


ODD = [None, "", "   ", "\n\n", "one", "a b", "Tab\tand\x0bfeed\x0c x\r\ny", " lead and trail ", "nbsp\xa0here", " sep \x85 x",
       "ü" * 40, "x " * 3000, "it's WE'LL don''t", "日本語 テスト ４５", "<|endoftext|> <|im_start|>x", "😀 ok 👨‍👩‍👧", "Σίσυφος ΣΑΣ İ",
       "\x1c a\x1cb \x1f", "a  b   c\n \n d"]
