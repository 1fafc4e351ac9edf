from pathlib import Path

import pytest

from weftline.llm import licenses

COMMON = Path("/usr/share/common-licenses")


def found(spark, texts: list[str]) -> list:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license for r in licenses.scan(rows).orderBy("doc_id").collect()]


def test_titled_and_listed_forms(spark):
    bsd2, bsd3 = licenses.TEXTS["BSD-2-Clause"], licenses.bsd3("the copyright holder", "COPYRIGHT HOLDERS")
    texts = [
        "MIT License\n\nCopyright (c) 2020 Some One\n\n" + licenses.TEXTS["MIT"],
        "The MIT License (MIT)\r\n\r\nCopyright (c) 2020 Some One\r\n\r\n" + licenses.TEXTS["MIT"],
        "ISC License\n\nCopyright (c) 2020, Some One\n\n" + licenses.TEXTS["ISC"],
        "BSD 2-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + bsd2.replace("1. ", "* ").replace("2. ", "* "),
        "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\n\n" + bsd3,
        bsd3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "),
        bsd3.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) "),  # the line with (c) is taken for copyright
        "Other License\n\n" + licenses.TEXTS["MIT"],
    ]
    assert found(spark, texts) == ["MIT", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", None, None]


def test_whole_files_of_this_machine(spark):
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    if not all((COMMON / n).exists() for n in names):
        pytest.skip("no common licences")
    assert found(spark, [(COMMON / n).read_text() for n in names]) == list(names.values())
    bare = (COMMON / "Apache-2.0").read_text().split("END OF TERMS")[0]
    old = (COMMON / "GPL-2").read_text().replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")
    assert found(spark, [bare, bare[bare.index("TERMS AND CONDITIONS FOR USE") :], old]) == ["Apache-2.0", "Apache-2.0", "GPL-2.0"]


def test_no_text_is_two_licences_and_both_canonical_forms_agree(spark):
    rows = spark.createDataFrame([("", "notice", x) for xs in licenses.NOTICES.values() for x in xs] + [(n, "text", t) for n, t in licenses.forms()], "license string, kind string, body string")
    got, of = rows.select("license", "kind", "body", licenses.canonical(rows["body"]).alias("c")).collect(), {}
    assert all(r.c == licenses.canonical_text(r.body) for r in got) and len(got) > 100
    for r in got:
        if r.kind == "text":
            of.setdefault(r.c, set()).add(r.license)
    assert all(len(names) == 1 for names in of.values())
