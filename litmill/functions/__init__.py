"""litmill subpackage."""
