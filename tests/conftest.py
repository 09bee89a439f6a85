import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quireframe.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def run(run_id, text, x, y, size=12.0, *, scale=1.0, width=None, font="Helvetica", color="#000000", mode=0, space=False, doc=1, page=0, angle=0.0):
    """A text run with the defaults of a plain horizontal object: advance 0.5 em per character."""
    import math

    eff = size * scale
    adv = len(text) * eff * 0.5
    w = adv if width is None else width
    a, b = scale * math.cos(math.radians(angle)), scale * math.sin(math.radians(angle))
    return dict(doc_id=doc, page_index=page, run_id=run_id, text=text, font_name=font, size_pt=float(size), size_eff_pt=float(eff), x=float(x), y=float(y), w=float(w), h=float(eff),
                a=a, b=b, e=float(x), f=float(y), virtual_space_before=space, advance_pt=float(adv), render_mode=mode, color=color)


RUN_SCHEMA = ("doc_id long, page_index int, run_id int, text string, font_name string, size_pt double, size_eff_pt double, x double, y double, w double, h double, "
              "a double, b double, e double, f double, virtual_space_before boolean, advance_pt double, render_mode int, color string")


def run_frame(spark, rows):
    names = [c.strip().split(" ")[0] for c in RUN_SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RUN_SCHEMA)
