"""sparkredact: find and replace sensitive data in text corpora with Spark DataFrames.

Every public operator is a ``DataFrame -> DataFrame`` transform (usable with
``df.transform``).  Sub-packages:

* ``sources``   -- readers for documents, pages, model outputs, ground truth, and
                   the derived test corpus
* ``functions`` -- Column-level helpers (regex, checksums, cleaning, labels)
* ``operators`` -- detection, parsing, merge, roles, labels, substitution,
                   review, evaluation, retention, audit
* ``plans``     -- end-to-end compositions (extract, anonymize, dataset run)
* ``streaming`` -- the same per-document transforms on a file stream
"""

__version__ = "0.1.0"
