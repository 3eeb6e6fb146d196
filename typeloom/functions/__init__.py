"""typeloom subpackage."""
