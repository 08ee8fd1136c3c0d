"""Where rows come from and go to: source trees and the versioned index store."""
