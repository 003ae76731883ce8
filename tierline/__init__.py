"""tierline: layered (bronze / silver / gold) data work on Spark DataFrames.

Every public function takes and returns DataFrames; nothing is collected to
the driver except bounded field lists needed to build a projection.
"""

from tierline.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
