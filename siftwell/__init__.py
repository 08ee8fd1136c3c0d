"""A PySpark engine for hybrid search over source trees and text collections."""
