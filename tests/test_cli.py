import numpy as np

from rasterloom import cli
from rasterloom.sources import formats as fm


def test_commands(tmp_path, capsys):
    p = lambda n: str(tmp_path / n)
    image = np.arange(20, dtype=np.uint16).reshape(4, 5) * 3000
    (tmp_path / "a.tif").write_bytes(fm.tiff_encode(image))
    assert cli.main(["imagesize", p("a.tif")]) == 0 and capsys.readouterr().out == "5x4\n"
    assert cli.main(["convert", p("a.tif"), p("a.png")]) == 0
    assert fm.png_decode((tmp_path / "a.png").read_bytes()).shape == (4, 5, 3)
    (tmp_path / "x").write_bytes(b"content")
    for _ in range(2):
        assert cli.main(["container-save", p("box.tif"), "n", p("x")]) == 0
    assert cli.main(["container-load", p("box.tif"), "n", p("y")]) == 0 and (tmp_path / "y").read_bytes() == b"content"
    mask = np.eye(5, dtype=bool)
    (tmp_path / "a.png").write_bytes(fm.embedded_mask_write((tmp_path / "a.png").read_bytes(), fm.treemask_dump(mask)))
    (tmp_path / "b.png").write_bytes(fm.png_encode(np.zeros((5, 5), np.uint8)))
    assert cli.main(["mask-copy", p("a.png"), p("b.png")]) == 0
    assert cli.main(["mask-dump", "--raw", p("b.png"), p("m")]) == 0 and (fm.treemask_load((tmp_path / "m").read_bytes()) == mask).all()
    assert cli.main(["mask-dump", p("b.png"), p("m.png")]) == 0 and (fm.png_decode((tmp_path / "m.png").read_bytes()) == mask * 255).all()
    assert cli.main(["other"]) == 2
