import duckdb
from pyspark.sql import functions as F

from corpuslens.functions import titles
from corpuslens.operators import objectives, pages
from corpuslens.queries import ORACLES, QUERIES


def test_title_endings(spark):
    cases = {
        "Gestión de residuos sólidos, Arequipa 2023": ("Gestión de residuos sólidos", "place_and_year", ["Arequipa"], True),
        "Gestión de residuos en la ciudad de Arequipa, 2023": ("Gestión de residuos", "place_and_year", ["Arequipa"], True),
        "Diseño de una red de agua, 2020-2021.": ("Diseño de una red de agua", "year_after_separator", [], True),
        "Ventas de la empresa durante el periodo 2022": ("Ventas de la empresa", "year_after_temporal_word", [], True),
        "Mejora de procesos textiles - Perú": ("Mejora de procesos textiles", "place_after_separator", ["Perú"], True),
        "Mejora de procesos textiles en MADRE DE DIOS": ("Mejora de procesos textiles", "place_after_word", ["Madre de Dios"], True),
        "Norma ISO 9001-2015": ("Norma ISO 9001-2015", "none", [], False),
        "Arequipa 2023": ("Arequipa 2023", "place_and_year", ["Arequipa"], False),
        "Plan de negocio en Arequipa en el año 2023": ("Plan de negocio", "year_after_temporal_word", ["Arequipa"], True),
        "Nothing to cut here": ("Nothing to cut here", "none", [], False),
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = frame.select("i", titles.strip_suffix(F.col("t")).alias("s")).orderBy("i").select("s.*").collect()
    assert [(r.title, r.pattern, r.places, r.stripped) for r in got] == list(cases.values())
    assert sum(r.n for r in titles.title_profile(frame, "t").collect()) == len(cases)


BODY = """1.3 Objetivos
1.3.1. Objetivo general
Determinar la relación entre el clima laboral y
la productividad de los trabajadores.
1.3.2. Objetivos específicos
- Identificar los factores del clima
laboral;
- Medir la productividad.
1.4. Justificación
Es importante."""


def run(spark, texts, source="text_layer"):
    rows = [("d", i, t, source) for i, t in enumerate(texts)]
    return objectives.locate_all(spark.createDataFrame(rows, "doc string, page int, text string, source string")).first()


def test_objectives_in_the_body(spark):
    contents = "ÍNDICE\nObjetivo general ........ 12"
    found = run(spark, ["Portada", contents, BODY])
    assert found.general == "Determinar la relación entre el clima laboral y la productividad de los trabajadores."
    assert found.specific == "- Identificar los factores del clima laboral;\n- Medir la productividad."
    assert (found.pattern, found.page_start, found.page_end, found.flags) == ("objetivo_general", 2, 2, [])


def test_objectives_across_pages_and_flags(spark):
    found = run(spark, ["El objetivo general es el siguiente:\nAnalizar el consumo de energía en", "los hogares rurales de la región.", "Capítulo II"], "ocr")
    assert (found.general, found.pattern) == ("Analizar el consumo de energía en los hogares rurales de la región.", "objetivo_general_intro")
    assert found.flags == ["specific_missing", "ocr_page"] and (found.page_start, found.page_end) == (0, 1)


def test_objectives_fallbacks(spark):
    block = run(spark, ["OBJETIVOS DE LA INVESTIGACIÓN\nProponer un modelo de gestión para la empresa textil.\nHipótesis"])
    assert block.pattern == "objetivos_block" and "block_fallback" in block.flags
    abstract = run(spark, ["RESUMEN\nObjetivo general: Evaluar el efecto del riego en los cultivos de la zona alta.\nPalabras clave: riego"])
    assert "abstract_only" in abstract.flags and abstract.general.startswith("Evaluar")
    assert run(spark, ["nada que ver"]).status == "not_found"
    assert run(spark, ["Objetivo general\n12"]).status == "not_found"


def test_running_lines(spark):
    texts = [f"Universidad\nTesis {i}\nBody {chr(97 + i)}\nmore {chr(97 + i)}\nPágina {i + 1}" for i in range(6)] + ["Universidad"]
    frame = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, page int, text string")
    got = pages.remove_running_lines(frame, 2).orderBy("page").collect()
    assert [r.text for r in got] == [f"Body {chr(97 + i)}\nmore {chr(97 + i)}" for i in range(6)] + ["Universidad"]
    assert [r.lines_removed for r in got] == [3] * 6 + [0]


def test_running_lines_as_their_sql(spark, tmp_path):
    """Page numbers at the edge, spaces other than the plain one, final sigmas, line ends of other kinds, null and repeated ids."""
    rows = [(i, "s", f"Head ΑΣ.\nbody {chr(97 + i)}\nmore {chr(97 + i)}\nvi.") for i in range(6)]
    rows += [(i, "s", f"\u00a0\nΗΕΑΔ ασ {i}\u3000\nHead ασ.\nx{i}y\nPage {i}\u2003") for i in range(6, 12)]
    rows += [(i, "t", f"12\r\n\t\nbody {i} {chr(97 + i)}\nend\u00a0 {i}\nHEAD İ") for i in range(12, 17)]
    rows += [(17, "t", None), (18, "t", " \n\u00a0"), (19, None, "Head ΑΣ.\nvi\nx"), (20, "t", "head i"), (None, "t", "head i\nand\nthis"), (0, "t", "12\r\nhead i\nz"), (21, "t", "a\n13\r\nb\nxi"), (21, "t", "a\n13\r\nb\nxi")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(ORACLES["running_lines"]).fetchall()}
    got = [tuple(r) for r in QUERIES["running_lines"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and sum(n for _, n in want) > 20


def test_running_lines_need_enough_pages(spark):
    frame = spark.createDataFrame([("d", i, f"Head\nbody {i} x\nend {chr(97 + i)}") for i in range(4)], "doc string, page int, text string")
    assert {r.lines_removed for r in pages.remove_running_lines(frame, 1).collect()} == {0}
