from folio.sources import tables  # noqa: F401  its views are what operators name
