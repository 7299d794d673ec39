"""The shared folder is the cluster's; it is never made up."""

import pytest

from tributary import session


class _Conf:
    def get(self, key, default=None):
        return default


class _Unset:
    conf = _Conf()


def test_unset_checkpoint_folder_is_an_error_that_names_the_setting():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(_Unset())


def test_defaults_do_not_set_overwrite_mode():
    assert "spark.sql.sources.partitionOverwriteMode" not in session.SQL_DEFAULTS
