"""Queries over whole texts find what stands behind the first match or the first characters."""

from courtlens.plans import QUERIES


def test_all_contacts(spark, tmp_path):
    rows = [(1, "to a.b@c.org or x@broken, call 317-555-0100 or 12 34 56 78 90 12"), (2, "nobody"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.check, r.entity, r.name, r.detail) for r in QUERIES["dq_contacts_in_text"](spark, str(tmp_path)).collect())
    assert got == [("contact_email", 1, "email 2", "x@broken"), ("contact_phone", 1, "phone 2", "12 34 56 78 90 12"), ("no_contact", 2, "", ""), ("no_contact", 3, "", "")]


def test_whole_texts(spark, tmp_path):
    late = "word " * 30 + "zebra"
    spark.createDataFrame([(1, late)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = QUERIES["canonical_name"](spark, str(tmp_path)).first()
    assert row.canonical == "word zebra" and row.key == late and row.slug == late.replace(" ", "-")
    turns = [(1, 0, "user", late), (1, 1, "assistant", late)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = QUERIES["incoming_parse"](spark, str(tmp_path)).first()
    assert row.school == late and row.conference == f"Conf {late}"
