import gc
import weakref

from terravane.llm import bpe
from terravane.llm.common import give_back


def test_the_codec_goes_when_another_operator_gives_back():
    """A kept worker holds the codec from one encoding task to the next, and no longer."""
    bpe.codec.cache_clear()
    usual = gc.get_threshold()
    c = bpe.codec(*bpe.default_vocabulary())
    c.encode("unforeseeable circumstances")
    fst = weakref.ref(c.fst)
    del c
    give_back("bpe")
    assert bpe.codec.cache_info().currsize == 1 and fst() is not None
    give_back()
    assert bpe.codec.cache_info().currsize == 0 and fst() is None
    assert gc.get_threshold() == usual
