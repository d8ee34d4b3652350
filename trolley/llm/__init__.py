"""Training-data operators: decontamination, near-duplicate joins, mixing, token counts,
language identification, embedding near-duplicates, URL rules, chat formatting, HTML main
text and personal data. Nothing else in the library imports this subpackage.

Python workers get the functions of this subpackage by value, so executors need no copy
of the repository on their path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
