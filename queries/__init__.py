from queries import detection, documents, labelling, masking, records, streams  # noqa: F401
from queries.base import QUERIES, SQL  # noqa: F401
