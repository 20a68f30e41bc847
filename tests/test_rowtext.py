from millrace.engine import Engine
from millrace.sources.rowtext import import_folder


def test_import(spark, tmp_path):
    old = tmp_path / "old"
    old.mkdir()
    (old / "t.schema").write_text("t\nid:INT:NOT_NULL:PRIMARY_KEY\nname:VARCHAR(255)\nf:DOUBLE\nb:BOOLEAN\nd:DATE\n")
    (old / "t.data").write_text("INT:42|STRING:a\\|b\\nc\\\\n|NULL|BOOL:true|STRING:2024-03-15\n\nINT:-1|STRING:|FLOAT:2.5|NULL|NULL\n")
    (old / "o.schema").write_text("o\nid:INT\nt:INT:FK=t.id\n")
    (old / "o.data").write_text("INT:1|INT:42\n")
    e = Engine(spark, tmp_path / "new")
    assert import_folder(e.catalog, str(old)) == ["o", "t"]
    got = e.catalog.read_rows("t")
    assert got[0][:4] == (42, "a|b\nc\\n", None, True) and str(got[0][4]) == "2024-03-15" and got[1] == (-1, "", 2.5, None, None)
    assert e.schema("o")[1].references == ("t", "id") and e.schema("t")[1].length == 255
